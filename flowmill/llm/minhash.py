"""Operator 3: near-duplicate groups by b-bit MinHash.

1. Every text gets, in one pass, its number of distinct word shingles, ``bands * rows`` minima of
   its shingle hashes, and from them the band keys (``rows`` minima each) and a packed signature of
   the low two bits of every minimum, once its bits are stirred. With 32 bands of 4 rows a pair at similarity 0.75 misses all
   bands with probability 5e-6.
2. Texts with the same words are one class, represented by its smallest document id.
3. Representatives that share a band key are candidates. First each document is compared with the
   smallest document of all its keys alone. Candidates are dropped if their set sizes rule the threshold out
   or if their similarity as estimated from the signatures, corrected for the fourth of different minima
   whose two bits agree by chance, is more than five standard deviations below the threshold.
4. The rest are confirmed on the full shingle sets and joined into components.
5. Keys whose members lie in different components are then compared: members reside in blocks,
   those outside the key's largest component visit every block, and signatures are compared by bit
   counts there. The partners of highest agreement are confirmed first. Of what then still lies in
   different components every pair that sizes and signatures let pass is compared under its first
   common key: signatures meet without texts, then the texts of those who have a partner meet within
   the blocks; links between components come out, and are confirmed on the words again. Pairs that are
   connected need no test, so a group of n near copies costs about n tests, and the pairs of a group
   are never emitted.

No candidate is capped. Hot keys: counts are pre-aggregated, a left document with many partners is
dealt over salted tasks, blocks bound what a task holds.

Defined cases: null, empty or blank text has no shingle and stays alone; fewer than ``words`` words
are one shingle; a null document id can't be linked (component null, kept); rows with one id are
one document; long texts are compared whole; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import saved, small_batches
from flowmill.llm.components import components

#: A-Z to lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SIGNATURES = "doc_id long, key binary, n_shingles long, bands array<long>, sig array<long>"


def words_of(text: str | None) -> list[bytes]:
    """Split at white space (space and \\x09 to \\x0D), A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingles(words: list[bytes], k: int) -> set[tuple]:
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)}


class Signer:
    """Minima of linear hashes over the shingle hashes of a text; constants come from a fixed seed."""

    def __init__(self, bands: int, rows: int, words: int):
        draw = np.random.default_rng(20240229)
        n = bands * rows
        self.bands, self.rows, self.words = bands, rows, words
        self.a = draw.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 1 << 32, n, dtype=np.uint32)
        self.place = draw.integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.row = draw.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = draw.integers(0, 1 << 63, bands, dtype=np.uint64)

    @staticmethod
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles of a text of ``self.words`` words or more."""
        from xxhash import xxh3_64_digest

        h = np.frombuffer(b"".join(map(xxh3_64_digest, words)), ">u8").astype(np.uint64)
        n = len(h) - self.words + 1
        out = h[:n] * self.place[0]
        for i in range(1, self.words):
            out += h[i : i + n] * self.place[i]
        return np.unique(self.mixed(out))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = None
        for i in range(0, len(x), 1024):
            part = (x[i : i + 1024, None] * self.a + self.b).min(axis=0)
            out = part if out is None else np.minimum(out, part)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        rows = minima.astype(np.uint64).reshape(self.bands, self.rows)
        return self.mixed((rows * self.row).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)

    @staticmethod
    def low_bits(minima: np.ndarray) -> np.ndarray:
        """The two bits that are kept of each minimum. The hashes are linear, so whether the low bits of two shingles agree
        would be the same under all of them; stirred, they agree in a fourth of the hashes, however few shingles there are."""
        x = minima.astype(np.uint32)
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
        return (x ^ (x >> np.uint32(16))) & np.uint32(3)

    @classmethod
    def packed(cls, minima: np.ndarray) -> np.ndarray:
        """Bit 0 of the two of all minima, then bit 1 of all, as longs."""
        minima = cls.low_bits(minima)
        m = np.concatenate([minima & 1, (minima >> 1) & 1]).astype(np.uint8)
        return np.packbits(m).view(">i8").astype(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    if bands * rows % 64:
        raise ValueError("bands * rows must be a multiple of 64")

    def sign(batches):
        import pyarrow as pa

        signer = Signer(bands, rows, words)
        for batch in batches:
            keys, sizes, band_keys, sigs, band_at, sig_at = [], [], [], [], [0], [0]
            for text in batch.column(1):
                w = words_of(text.as_py())
                keys.append(hashlib.md5(b" ".join(w)).digest() if w else None)
                if len(w) >= words:
                    h = signer.hashes(w)
                    m = signer.minima(h)
                    sizes.append(len(h))
                    band_keys.append(signer.keys(m))
                    sigs.append(signer.packed(m))
                    band_at.append(band_at[-1] + bands)
                    sig_at.append(sig_at[-1] + len(sigs[-1]))
                else:
                    sizes.append(1 if w else 0)
                    band_at.append(band_at[-1])
                    sig_at.append(sig_at[-1])
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(v) if v else np.empty(0, np.int64))) for at, v in ((band_at, band_keys), (sig_at, sigs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "key", "n_shingles", "bands", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, SIGNATURES)


#: Share of different minima whose two kept bits agree.
CHANCE = 0.25


def estimated_similarity(agree, n: int):
    """Similarity from the number of agreeing minima of ``n``, corrected for chance agreement (numbers or columns)."""
    return (agree / n - CHANCE) / (1 - CHANCE)


def least_estimate(threshold: float, n: int) -> float:
    """The threshold less five standard deviations of the estimate: pairs at it fall below with a chance of 3e-7."""
    agree = threshold + (1 - threshold) * CHANCE
    return threshold - 5 * (agree * (1 - agree) / n) ** 0.5 / (1 - CHANCE)


def _agree(x: str, y: str, n: int):
    half = n // 64
    differ = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]).bitwiseOR(F.col(x)[i + half].bitwiseXOR(F.col(y)[i + half]))) for i in range(half)]
    total = differ[0]
    for d in differ[1:]:
        total = total + d
    return F.lit(n) - total


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int, per_task: int = 256) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    ``texts``: (id, text) of all documents named. Partners of one left document are dealt over salted
    groups of about ``per_task``; a group's left text comes first in its sorted run, so a task holds
    one set and reads partners one by one.
    """

    def compare(batches):
        import pyarrow as pa

        at, heads = None, []
        for batch in batches:
            out: list[list] = [[], []]
            columns = [batch.column(i) for i in range(4)]
            for a, salt, doc, text in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3]):
                own = shingles(words_of(text.as_py()), words)
                if (a, salt) != at:
                    at, heads = (a, salt), []
                if doc is None:
                    heads.append(own)
                    continue
                for head in heads:
                    both = len(own & head)
                    if both and 100 * both >= percent * (len(own) + len(head) - both):
                        out[0].append(a)
                        out[1].append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).alias("salts"))
    dealt = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    roles = dealt.select(F.col("b").alias("id"), "a", "salt", F.col("b").alias("doc")).unionByName(
        dealt.select(F.col("a").alias("id"), "a", "salt", F.lit(None).cast("long").alias("doc")).distinct()
    )
    rows = roles.join(texts, "id").select("a", "salt", "doc", "text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("doc")).mapInArrow(compare, "a long, b long").distinct()


#: Rounds of comparison over keys with several components before the full one: how many partners of a
#: document are confirmed, by agreement, of all its partners or (True) of each component's.
ROUNDS = ((False, 2),)


def _placed(members: DataFrame, block: int) -> DataFrame:
    """Members of each key at home in a block (``at``), those outside the key's largest component also
    as visitors of all of its blocks; partitioned and sorted so that residents come first."""
    counts = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    largest = counts.groupBy("bucket").agg(F.max(F.struct("k", "comp")).getField("comp").alias("largest"), F.ceil(F.sum("k") / block).cast("int").alias("blocks"))
    sized = members.join(largest, "bucket")
    at_home = sized.select(*members.columns, F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("at"), F.lit(False).alias("visits"))
    visiting = sized.where(F.col("comp") != F.col("largest")).select(*members.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), F.lit(True).alias("visits"))
    return at_home.unionByName(visiting).repartition("bucket", "at").sortWithinPartitions("bucket", "at", "visits")


def _meetings(batches, width: int):
    """Of sorted runs of ``_placed`` rows of ``width`` columns, each visitor with the residents it meets:
    ``(visitor, residents, arrays of the residents' columns 1 to 3, their signatures)``; the end of a batch
    gives None."""
    key, residents, home = None, [], None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(width))):
            if (row[0], row[width - 2]) != key:
                key, residents, home = (row[0], row[width - 2]), [], None
            if not row[width - 1]:
                residents.append(row)
                continue
            if home is None and residents:
                home = (*(np.array([r[i] for r in residents], dtype=np.int64) for i in (1, 2, 3)), np.array([r[4] for r in residents], dtype=np.int64).view(np.uint64))
            if home is not None:
                yield row, residents, home
        yield None


def _passing(row, home, percent: int, n: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Residents in other components that sizes and signatures let pass, and their agreement."""
    _, comps, sizes, sig = home
    half = n // 64
    at = np.flatnonzero((comps != row[2]) & (100 * np.minimum(sizes, row[3]) >= percent * np.maximum(sizes, row[3])))
    x = sig[at] ^ np.array(row[4], dtype=np.int64).view(np.uint64)
    agree = n - np.bitwise_count(x[:, :half] | x[:, half:]).sum(axis=1).astype(np.int64)
    near = estimated_similarity(agree, n) >= floor
    return at[near], agree[near]


def _in_full(members: DataFrame, heads: DataFrame, texts: DataFrame, floor: float, n: int, percent: int, words: int, block: int = 512) -> DataFrame:
    """Pairs of members in different components whose full sets of shingle hashes are similar, of those
    that sizes and signatures let pass.

    ``members``: bucket, doc_id, comp; ``heads``: doc_id, n_shingles, sig, bands. Signatures meet first,
    without texts: who has a partner under the pair's first common key is named with the block. Only
    these meet again, with their texts, and sets are made when first needed. A pair is not compared if
    this run's links have connected it by then; so what is returned are links between components, not
    the pairs of a group.
    """

    def first_common(row, residents, home):
        at, _ = _passing(row, home, percent, n, floor)
        own, bands = np.array(row[5], dtype=np.int64), np.array([residents[j][5] for j in at.tolist()], dtype=np.int64).reshape(len(at), len(row[5]))
        return at[own[(bands == own).argmax(axis=1)] == row[0]]

    def name(batches):
        import pyarrow as pa

        found: set = set()
        for met in _meetings(batches, 8):
            if met is None:
                rows = sorted(found)
                found = set()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["bucket", "doc_id", "at", "visits"])
                continue
            row, residents, home = met
            partners = first_common(row, residents, home).tolist()
            if partners:
                found.add((row[0], row[1], row[6], True))
                found.update((row[0], residents[j][1], row[6], False) for j in partners)

    def compare(batches):
        import pyarrow as pa

        signer, key, sets, parent, found = Signer(1, 64, words), None, {}, {}, []

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        def hashes(row):
            return signer.hashes(words_of(row[6]))

        def similar(a, b):
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * both >= percent * (len(a) + len(b) - both)

        for met in _meetings(batches, 9):
            if met is None:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
                found = []
                continue
            row, residents, home = met
            if (row[0], row[7]) != key:
                key, sets, parent = (row[0], row[7]), {}, {}
            mine = None
            for j in first_common(row, residents, home).tolist():
                other = residents[j]
                a, b = root(row[2]), root(other[2])
                if a == b:
                    continue
                mine = hashes(row) if mine is None else mine
                if j not in sets:
                    sets[j] = hashes(other)
                if similar(mine, sets[j]):
                    parent[max(a, b)] = min(a, b)
                    found.append((min(row[1], other[1]), max(row[1], other[1])))

    order = ["bucket", "at", "visits", "doc_id"]
    signed = members.join(heads, "doc_id").select("bucket", "doc_id", "comp", "n_shingles", "sig", "bands")
    named = saved(_placed(signed, block).mapInArrow(name, "bucket long, doc_id long, at int, visits boolean").distinct(), "named")
    full = named.join(members, ["bucket", "doc_id"]).join(heads, "doc_id").join(texts.withColumnRenamed("id", "doc_id"), "doc_id")
    full = full.select("bucket", "doc_id", "comp", "n_shingles", "sig", "bands", "text", "at", "visits")
    return full.repartition("bucket", "at").sortWithinPartitions(*order).mapInArrow(compare, "a long, b long").distinct()


def _blocked(members: DataFrame, floor: float, n: int, percent: int, block: int, each: bool, most: int) -> DataFrame:
    """Pairs of members of one key in different components that sizes and signatures let pass.

    Members of a key reside in blocks; those outside the key's largest component also visit all of
    its blocks, so a run of a sorted partition holds about ``block`` residents and takes the visitors
    one by one. Of a visitor's partners in a run the ``most`` of highest agreement are returned, of
    all or (``each``) of each component's.
    """

    def compare(batches):
        import pyarrow as pa

        def best(row, home):
            ids, comps = home[:2]
            at, agree = _passing(row, home, percent, n, floor)
            group = comps[at] if each else np.zeros(len(at), np.int64)
            order = np.lexsort((ids[at], -agree, group))
            at, group = at[order], group[order]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else np.empty(0, np.intp)
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            return [(min(row[1], int(ids[j])), max(row[1], int(ids[j]))) for j in at[rank < most]]

        found: set = set()
        for met in _meetings(batches, 7):
            if met is None:
                pairs = sorted(found)
                found = set()
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])
            else:
                found.update(best(met[0], met[2]))

    return _placed(members.select("bucket", "doc_id", "comp", "n_shingles", "sig"), block).mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, bands: int = 32, rows: int = 4, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id (smallest id with the same words),
    component_id (smallest id linked over any number of steps) and kept."""
    small_batches(docs.sparkSession)
    n = bands * rows
    floor = least_estimate(percent / 100, n)
    signed = saved(signatures(docs, words, bands, rows, id_col, text_col), "signatures")
    classes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    copied = saved(classes.where("n > 1").drop("n"), "classes")
    marked = signed.join(copied.hint("merge"), "key", "left")
    alone = marked.where("size(bands) > 0 and doc_id is not null and (class_id is null or class_id = doc_id)")
    heads = saved(alone.select("doc_id", "n_shingles", "bands", "sig"), "heads")

    keyed = heads.select("doc_id", F.explode("bands").alias("bucket"))
    leads = keyed.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead <> last").drop("last")
    shared = saved(keyed.join(leads.hint("merge"), "bucket"), "buckets")
    side = heads.select("doc_id", "n_shingles", "sig")
    involved = shared.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = saved(texts.join(involved.hint("merge"), "id", "left_semi"), "texts")  # the one shuffle of all texts, at any size

    star = shared.groupBy(F.col("doc_id").alias("b")).agg(F.min("lead").alias("a")).where("a <> b")
    near = (
        star.join(side.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a")
        .join(side.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .where(estimated_similarity(_agree("sa", "sb", n), n) >= floor)
        .select("a", "b")
    )
    linked = saved(confirmed(saved(near, "candidates"), texts, words, percent), "links")
    comps = components(linked)
    for round_ in (*ROUNDS, None):
        now = shared.select("bucket", "doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
        open_keys = now.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
        rest = now.join(open_keys, "bucket")
        if round_:
            more = _blocked(saved(rest.join(side, "doc_id"), "open"), floor, n, percent, block, *round_)
        else:
            more = _in_full(saved(rest, "open"), heads, texts, floor, n, percent, words)
        more = saved(more, "candidates")
        if more.isEmpty():
            break
        linked = saved(linked.unionByName(confirmed(more, texts, words, percent)), "links")
        comps = components(linked)
    comps = comps.withColumnRenamed("node", "class_id")
    out = signed.select("doc_id", "n_shingles", "key").join(copied.hint("merge"), "key", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(comps, "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that have a smaller linked document."""
    found = near_duplicates(docs, id_col=id_col, **options)
    gone = found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
