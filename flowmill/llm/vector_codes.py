"""Operator 13: vectors as one byte a part, by Lloyd's rounds with Hamerly's bounds.

Components become integers, so distances, ties and means are exact. For every part of a vector a row
keeps its nearest entry, an upper bound of the distance to it and a lower bound of the distance to every
other entry. After the codebook moved, the upper bound grows by the own entry's move and the lower one
falls by the largest other move. An assignment stands if the upper bound is strictly below the lower bound, or
below half the distance from the own entry to the next; else the exact distance to the own entry is taken
and the test made again; parts that still fail are compared with all entries. As the test is strict
and bounds are rounded outwards, equal distances are always compared and go to the lower index.

Each round is one pass that writes vectors and bounds to the shared folder and removes the table before,
then one sum per part and entry with partial sums in the tasks. The codebooks, 256 entries at most, are
all that the driver holds.

Arithmetic: doubles as long as all sums stay whole numbers below 2^53, else 64-bit integers, else Python
integers. An error beyond a long is null.

Defined cases: vectors that are null, hold a null or non-finite component, or have another length than that of
the smallest vec_id are dropped; a length that 4 doesn't divide gives parts that differ by one; fewer
than 256 vectors give as many entries; a null vec_id comes after all others; repeated ids are rows of
their own, in the order of their vectors; null labels are one label; an empty table gives an empty
result; extra columns don't matter. A vector is one row, however long.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import saved

#: Bounds are moved outwards by this factor, far above the rounding of a few operations.
OUT = 1 + 2.0**-40
LIMB = 64


@dataclass
class Codebook:
    """``parts``: for each part the integer entries, as rows of Python ints or of int64."""

    parts: list[np.ndarray]

    def text(self) -> str:
        return ",".join(str(int(x)) for p in self.parts for x in p.ravel())


def bounds_of(d: int, parts: int) -> list[tuple[int, int]]:
    return [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); int64 where it fits, Python ints elsewhere."""
    y = np.floor(x.astype(np.float64) * scale)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    return np.array([int(v) for v in y.ravel()], dtype=object).reshape(y.shape)


def fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the narrowest kind in which squared distances are exact."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    top = 4 * max(a.shape[1] for a in arrays) * most * most
    kind = np.float64 if top < 2**53 else np.int64 if top < 2**63 else object
    return [a.astype(kind) for a in arrays]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances, exact."""
    x, entries = fitting(x, entries)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def own_distance(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    x, entries = fitting(x, entries)
    return ((x - entries) ** 2).sum(axis=1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Assigner:
    """Assigns the parts at one position, given their entries before and after the last move."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries, k = entries, len(entries)
        apart = root(distances(entries, entries)) if k else np.zeros((0, 0))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 / OUT if k > 1 else np.full(k, np.inf)
        self.move = root(own_distance(entries, before)) * OUT if before is not None else np.zeros(k)
        ranked = np.argsort(-self.move, kind="stable")
        self.most = np.full(k, self.move[ranked[0]] if k else 0.0)
        if k:
            self.most[ranked[0]] = self.move[ranked[1]] if k > 1 else 0.0

    def __call__(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Updates the three in place; the number of parts that were compared with all entries."""
        upper[:] = (upper + self.move[near]) * OUT
        lower[:] = np.maximum(lower - self.most[near], 0.0) / OUT
        safe = np.maximum(lower, self.half[near])
        open_ = np.flatnonzero(~(upper < safe))
        if not len(open_):
            return 0
        upper[open_] = root(own_distance(x[open_], self.entries[near[open_]])) * OUT
        open_ = open_[~(upper[open_] < safe[open_])]
        for i in range(0, len(open_), 4096):
            rows = open_[i : i + 4096]
            d = distances(x[rows], self.entries)
            best = np.argmin(d, axis=1)
            at = np.arange(len(rows))
            near[rows], upper[rows] = best, root(d[at, best]) * OUT
            if d.shape[1] > 1:
                d = root(d)
                d[at, best] = np.inf
                lower[rows] = d.min(axis=1) / OUT
            else:
                lower[rows] = np.inf
        return len(open_)


def matrix(column, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def lists(values: np.ndarray):
    import pyarrow as pa

    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(values.ravel()))


def assigned(state: DataFrame, book: Codebook, before: Codebook | None, dimension: int, scale: int) -> DataFrame:
    """``state`` (vec_id, label, vector and, after the first round, near, upper, lower) with new bounds,
    ``scans``, the number of parts compared with all entries, and ``error`` (null beyond a long)."""
    first, k = before is None, len(book.parts)

    def one(batches):
        import pyarrow as pa

        parts = [Assigner(e, None if first else before.parts[p]) for p, e in enumerate(book.parts)]
        for b in batches:
            x, n = integers(matrix(b.column("vector"), dimension), scale), b.num_rows
            if first:
                near, upper, lower = np.zeros((n, k), np.int32), np.full((n, k), np.inf), np.zeros((n, k))
            else:
                near, upper, lower = (matrix(b.column(c), k).copy() for c in ("near", "upper", "lower"))
            scans, error = 0, np.zeros(n, object)
            for p, (low, high) in enumerate(bounds_of(dimension, k)):
                scans += parts[p](x[:, low:high], near[:, p], upper[:, p], lower[:, p])
                d = own_distance(x[:, low:high], book.parts[p][near[:, p]])
                error = error + np.array([int(v) for v in d], dtype=object)
            told = pa.array([int(e) if e < 2**63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("vector"), lists(near), lists(upper), lists(lower), told, pa.array([scans] + [0] * (n - 1) if n else [], pa.int64())], names=names)

    names = ["vec_id", "label", "vector", "near", "upper", "lower", "error", "scans"]
    kinds = dict(state.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector {kinds['vector']}, near array<int>, upper array<double>, lower array<double>, error long, scans long"
    return state.mapInArrow(one, schema)


def moved(state: DataFrame, book: Codebook, dimension: int, scale: int) -> Codebook:
    """The codebook of the means of what is assigned to each entry, rounded down."""
    k = len(book.parts)
    widths = [high - low for low, high in bounds_of(dimension, k)]
    most = max(widths)

    def sums(batches):
        import pyarrow as pa

        total = [[np.zeros((len(e), w), object), np.zeros(len(e), np.int64)] for e, w in zip(book.parts, widths)]
        for b in batches:
            x, near = integers(matrix(b.column(0), dimension), scale), matrix(b.column(1), k)
            for p, (low, high) in enumerate(bounds_of(dimension, k)):
                part, own = x[:, low:high], near[:, p]
                small = part.dtype != object and (not part.size or int(np.abs(part).max()) * len(part) < 2**62)
                got = np.zeros(total[p][0].shape, np.int64 if small else object)
                np.add.at(got, own, part)
                total[p][0] += got
                total[p][1] += np.bincount(own, minlength=len(total[p][1]))
        rows = {"part": [], "entry": [], "n": [], "high": [], "low": []}
        for p, (s, n) in enumerate(total):
            for e in np.flatnonzero(n):
                v = [int(a) for a in s[e]] + [0] * (most - widths[p])
                for name, value in zip(rows, (p, int(e), int(n[e]), [str(a >> LIMB) for a in v], [str(a & (2**LIMB - 1)) for a in v])):
                    rows[name].append(value)
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.string())), ("low", pa.list_(pa.string()))]))

    parts = state.select("vector", "near").mapInArrow(sums, "part int, entry int, n long, high array<string>, low array<string>")
    add = lambda c, i: F.sum(F.get(c, F.lit(i)).cast("decimal(38,0)")).cast("string")
    rows = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(add("high", i) for i in range(most))).alias("high"), F.array(*(add("low", i) for i in range(most))).alias("low"))
    new = [np.array(e, dtype=object) for e in book.parts]
    for r in rows.toLocalIterator():
        for i in range(widths[r.part]):
            new[r.part][r.entry, i] = ((int(r.high[i]) << LIMB) + int(r.low[i])) // r.n
    return Codebook([compact(e) for e in new])


def compact(e: np.ndarray) -> np.ndarray:
    return e.astype(np.int64) if not e.size or int(np.abs(e).max()) < 2**62 else e


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    # The largest float; what lies beyond it is infinite as a float.
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= F.lit(float(np.finfo(np.float32).max))))
    return rows.where(F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False)))


def compressed(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebook]:
    """``(rows, codebook)``; rows: (vec_id, label, vector, near, upper, lower, error, scans) after the last assignment."""
    state = usable(vectors, id_col, vector_col, label_col)
    start = state.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select(F.size("vector")).first()
    dimension = start[0] if start else 0
    state = state.where(F.size("vector") == dimension)
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    x = integers(np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), dimension), scale)
    book, before = Codebook([compact(x[:, low:high]) for low, high in bounds_of(dimension, parts)]), None
    for i in range(rounds + 1):
        state = saved(assigned(state, book, before, dimension, scale), "codes", instead_of=state if i else None)
        if i < rounds:
            before, book = book, moved(state, book, dimension, scale)
    return state, book


def vector_codes(vectors: DataFrame, **options) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``: two hex digits a part."""
    rows, book = compressed(vectors, **options)
    digest = hashlib.sha256(book.text().encode()).hexdigest()
    by_label = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    code = F.array_join(F.transform("near", lambda i: F.lower(F.lpad(F.hex(i.cast("long")), 2, "0"))), "")
    joined = rows.join(by_label, rows["label"].eqNullSafe(by_label["of_label"]))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same by plain Lloyd rounds in DuckDB SQL."""
    steps = [
        f"""kept as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, label, embedding, len(embedding) as d from embeddings where embedding is not null and coalesce((select bool_and(v is not null and isfinite(v)) from unnest(embedding) as u(v)), true))""",
        f"""q as materialized (select r, (i - 1) * {parts} // d as part, i, floor(embedding[i]::double * {scale})::bigint as v from kept, unnest(range(1, d + 1)) as u(i))""",
        f"""b0 as materialized (select part, (r - 1)::bigint as entry, i, v from q where r <= {entries})""",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} as materialized (select r, part, min(entry) as entry, min(e) as e from (select r, part, entry, e, min(e) over (partition by r, part) as least from (select q.r, q.part, b.entry, sum((q.v - b.v) * (q.v - b.v))::bigint as e from q join b{n} b on q.part = b.part and q.i = b.i group by all)) where e = least group by r, part)")
        if n < rounds:
            steps.append(f"b{n + 1} as materialized (select b.part, b.entry, b.i, coalesce(m.v, b.v) as v from b{n} b left join (select a.part, a.entry, q.i, ((sum(q.v) - ((sum(q.v) % count(*)) + count(*)) % count(*)) // count(*))::bigint as v from a{n} a join q on a.r = q.r and a.part = q.part group by all) m on m.part = b.part and m.entry = b.entry and m.i = b.i)")
    steps += [
        f"c as (select r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, sum(e)::bigint as error from a{rounds} group by r)",
        f"s as (select sha256(string_agg(v::varchar, ',' order by part, entry, i)) as codebooks_sha256 from b{rounds})",
    ]
    return "with " + ",\n".join(steps) + "\nselect k.vec_id, c.code, c.error, sum(c.error) over (partition by k.label)::bigint as label_error, s.codebooks_sha256 from kept k join c using (r) cross join s"
