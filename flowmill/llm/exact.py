"""Operator 12: exact duplicates by a content sort (DataFrame functions alone).

1. Runs of white space become one space; a null text counts as empty.
2. A sample of keys, bounded by ``samples * max_ranges``, gives splitters that cut the sorted rows into
   ranges of about ``range_bytes``. A key is the text's leading characters, a digest of the whole text and
   a digest of the id: short whatever the text's length, equal texts are neighbours, and a group larger
   than a range is cut by the ids, so no task holds a hot group.
3. One shuffle by range; an external sort by (text, id) puts equals side by side, and each row's whole text
   is compared with its neighbour's. A change starts a run; the run's first row has its smallest id.
4. Only a group that holds a splitter's own text can reach into another range. The first rows of such runs
   (few a range) are compared again, on whole texts, and their counts added.

Memory of a task: Spark's sort and window buffers, which spill; a text as long as a row may be is one row.

Defined cases: null, empty and blank texts: null equals the empty text, all blank texts are equal to
one space; a null id comes after every other, so ``keep_id`` is null only where all ids of a group are null;
rows that repeat an id and text are one group, of which exactly one row is kept; an empty table gives
an empty result; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.llm.common import saved

#: Between the parts of a key; a normalised text holds none.
SEP = "\t"
LEAD = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def lead(text: Column) -> Column:
    """The part of the sort key that equal texts share."""
    return F.concat_ws(SEP, F.substring(text, 1, LEAD), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def place(text: Column, key: Column) -> Column:
    return F.concat_ws(SEP, lead(text), F.lpad(F.hex(F.xxhash64(key)), 16, "0"))


def splitters(docs: DataFrame, id_col: str, text_col: str, range_bytes: int, max_ranges: int, samples: int) -> list[str]:
    """Ascending keys that cut ``docs`` into ranges of about equal size in bytes."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    ranges = min(max_ranges, -(-((size or 0) + 64 * n) // range_bytes))
    if ranges < 2:
        return []
    some = docs.sample(min(1.0, samples * ranges / n), seed=12)
    text = normalised(F.col(text_col))
    drawn = sorted(some.select(place(text, F.col(id_col)), F.octet_length(text) + 64).collect(), key=lambda r: r[0].encode())
    step, seen, out = sum(r[1] for r in drawn) / ranges, 0, []
    for key, weight in drawn:
        seen += weight
        if seen >= step * (len(out) + 1) and len(out) < ranges - 1 and (not out or key != out[-1]):
            out.append(key)
    return out


def in_range(at: Column, cuts: list[str]) -> Column:
    """The number of splitters up to ``at``, by binary search."""
    cut, step, steps = listed(cuts), 1, []
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, s: F.when(F.get(cut, low + s - 1) <= at, low + s).otherwise(low))


def listed(values: list[str]) -> Column:
    """A constant array; normalised texts have no line break, so one literal carries all."""
    return F.split(F.lit("\n".join(values)), "\n")


def runs(docs: DataFrame, id_col: str, text_col: str, cuts: list[str]) -> DataFrame:
    """A row per document: its range and run, the run's size and smallest id, and whether it is the run's
    first; ``edge`` marks groups that may reach into another range, and ``text`` is theirs, once a run."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    rows = rows.withColumn("at", place(F.col("text"), F.col("doc_id"))).withColumn("range", in_range(F.col("at"), cuts))
    cut = listed([c.rsplit(SEP, 1)[0] for c in cuts])
    own = F.substring_index("at", SEP, 2)
    near = F.coalesce(own == F.get(cut, F.col("range")), F.lit(False)) | F.coalesce(own == F.get(cut, F.col("range") - 1), F.lit(False))
    rows = rows.select("doc_id", "text", "range", near.alias("edge"))
    order = W.partitionBy("range").orderBy("text", F.col("doc_id").asc_nulls_last())
    rows = rows.withColumn("first", F.coalesce(F.col("text") != F.lag("text").over(order), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("first").cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.select("range", "run", "doc_id", "first", "edge", F.unhex(F.sha2("text", 256)).alias("digest"), F.when(F.col("edge") & F.col("first"), F.col("text")).alias("text"))
    run = W.partitionBy("range", "run")
    return rows.withColumns({"n": F.count("*").over(run), "least": F.min("doc_id").over(run)})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 4 << 20, max_ranges: int = 50_000, samples: int = 10) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``."""
    cuts = splitters(docs, id_col, text_col, range_bytes, max_ranges, samples)
    rows = saved(runs(docs, id_col, text_col, cuts), "runs")
    heads = rows.where("edge and first").select("range", "run", "doc_id", "n", "text")
    whole = heads.groupBy("text").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "range", "run")).alias("top"), F.sum("n").alias("total"))
    merged = heads.join(whole, "text").select("range", "run", F.col("top.doc_id").alias("keep_id"), "total", ((F.col("top.range") == F.col("range")) & (F.col("top.run") == F.col("run"))).alias("leads"))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    inner = rows.where("not edge").select("doc_id", F.col("least").alias("keep_id"), F.col("n").alias("group_size"), F.col("first").alias("kept"), sha)
    edge = rows.where("edge").join(merged, ["range", "run"]).select("doc_id", "keep_id", F.col("total").alias("group_size"), (F.col("first") & F.col("leads")).alias("kept"), sha)
    return inner.unionByName(edge)


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows of ``docs`` whose id is kept; all columns stay. Ids must be unique."""
    kept = exact_duplicates(docs, id_col, text_col, **bounds).where("kept").select(F.col("doc_id").alias(id_col))
    return docs.join(kept, id_col, "left_semi")


ORACLE = r"""with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  row_number() over (partition by norm order by doc_id) = 1 as kept, sha256(norm) as text_sha256 from t"""
