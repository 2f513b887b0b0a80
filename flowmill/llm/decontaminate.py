"""Operator 1: benchmark decontamination by Wu-Manber search over words.

A test item gives windows of ``window`` consecutive words (all its words, if it has fewer). Windows
of one length form a group; within a group a table gives, for every block of two words that occurs
in a window, how far the window's end can be moved on at least (SHIFT), and windows are kept in
buckets by the hash of their last block. The search looks at the block that ends at a position,
skips by its shift (by the whole window for blocks that no window holds), and where the shift is
0 compares the bucket's windows word by word.

The documents never move: windows go to the tasks by a broadcast of at most ``max_pattern_bytes``;
beyond that size they are cut into chunks and the documents pass once per chunk, each pass
adding to the hits of the one before (written to the shared folder between passes).

Defined cases: null text, of a document or an item, has no words; an item without a word gives no
window; windows of items with null id hit words as others do, but these items are neither named nor
counted; items with one id are one item with all their windows; an empty item table marks nothing, an
empty document table gives no rows; very long texts are searched whole; rows are judged one by one,
so repeated rows give repeated results; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.common import fresh_name, saved

#: Bytes to word bytes: A-Z to lower case, 0-9, a-z and all of other scripts as they are, the rest to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

MATCH = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])

#: Number of all items without an id.
UNNAMED = -1


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WuManber:
    """Search for all windows of one length. ``items``: window (tuple of words) to its item numbers."""

    def __init__(self, length: int, items: dict[tuple, list[int]]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for window, numbers in items.items():
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                far = length - end
                if far < self.shift.get(block, self.most):
                    self.shift[block] = far
            self.buckets.setdefault(hash(window[-self.block :]), []).append((window, numbers))

    def search(self, words: list[bytes]):
        """Every ``(start, item numbers)`` at which a window occurs."""
        shift, most, length, two = self.shift.get, self.most, self.length, self.block == 2
        at, n = length - 1, len(words)
        while at < n:
            block = (words[at - 1], words[at]) if two else (words[at],)
            skip = shift(block, most)
            if skip:
                at += skip
                continue
            start = at - length + 1
            for window, numbers in self.buckets.get(hash(block), ()):
                if window[0] == words[start] and window == tuple(words[start : at + 1]):
                    yield start, numbers
            at += 1


def searchers(windows: list[tuple[int, bytes]]) -> list[WuManber]:
    groups: dict[int, dict[tuple, list[int]]] = {}
    for number, joined in windows:
        window = tuple(joined.split())
        groups.setdefault(len(window), {}).setdefault(window, []).append(number)
    return [WuManber(n, items) for n, items in sorted(groups.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def windows_of(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct item and window: ``item`` (string), ``win`` (its words, joined)."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[list] = [[], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                for win in {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ():
                    rows[0].append(item)
                    rows[1].append(win)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.binary())], names=["item", "win"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    return items.mapInArrow(cut, "item string, win binary").distinct()


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                 out: str = "match", max_pattern_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` and a struct ``out`` (its name made fresh): n_words, the merged word spans hit, and the items found."""
    wins = windows_of(benchmark, window, item_id, item_text).persist()
    size = wins.agg(F.coalesce(F.sum(F.length("win") + F.coalesce(F.length("item"), F.lit(0)) + 64), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-int(size) // max_pattern_bytes))
    schema, context = MATCH, docs.sparkSession.sparkContext
    result, out = docs, fresh_name(docs, out)
    for part in range(parts):
        rows = [(r.item, bytes(r.win)) for r in wins.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == part).toLocalIterator()]
        names = sorted({r[0] for r in rows if r[0] is not None})
        number = {None: UNNAMED} | {n: k for k, n in enumerate(names)}
        sent = context.broadcast((names, [(number[i], w) for i, w in rows]))
        result = result.withColumn(out, matcher(sent)(F.col(text_col), F.col(out) if part else F.lit(None).cast(schema)))
        if part + 1 < parts:
            result = saved(result, "decontaminate")
    wins.unpersist()
    return result


def matcher(sent):
    """The search as a vectorised function of (text, hits of earlier passes)."""
    tables: list = []

    def run(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        if not tables:
            names, windows = sent.value
            tables.append((names, searchers(windows)))
        names, finders = tables[0]
        rows = []
        for text, old_spans, old_items in zip(texts, before["spans"], before["items"]):
            words = words_of(text)
            spans, items = [], set()
            for finder in finders:
                for start, numbers in finder.search(words):
                    spans.append((start, start + finder.length))
                    items.update(numbers)
            found = {names[i] for i in items if i != UNNAMED}
            if old_spans is not None and len(old_spans):  # of items without an id, too
                spans += [(s["start"], s["end"]) for s in old_spans]
                found |= set(old_items)
            rows.append((len(words), [{"start": a, "end": b} for a, b in merged(spans)], sorted(found)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    run.__annotations__ = {"texts": pd.Series, "before": pd.DataFrame, "return": pd.DataFrame}
    return F.pandas_udf(run, MATCH)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: words, words hit, items found and their digest."""
    name = fresh_name(docs, "match")
    rows = with_matches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, window, out=name, **options)
    hit = F.aggregate(F.col(f"{name}.spans"), F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return rows.select(
        "doc_id", F.col(f"{name}.n_words").alias("n_words"), hit.alias("n_hit"), F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col(f"{name}.items"), ","), 256).alias("items_sha256"), (F.size(f"{name}.spans") > 0).alias("contaminated"), F.col(f"{name}.items").alias("items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_hit_share: float = 0.0, text_col: str = "text", **options) -> DataFrame:
    """The documents of which no more than ``max_hit_share`` of the words lie in test windows."""
    name = fresh_name(docs, "match")
    hit = F.aggregate(F.col(f"{name}.spans"), F.lit(0), lambda a, s: a + (s["end"] - s["start"]))
    rows = with_matches(docs, benchmark, window, text_col=text_col, out=name, **options)
    return rows.where(hit <= F.lit(max_hit_share) * F.col(f"{name}.n_words")).select(*docs.columns)


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
