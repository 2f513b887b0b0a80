"""Technical coefficients and the yearly Leontief solve.

lambda solves (I - C)' lambda = l on the productive block. Years are independent. A year of up to ``limit``
industries is one grouped task of n x n doubles: labels become row and column numbers in Spark, so the task
receives (int, int, double) cells and fills its matrix in one step. One factorisation serves lambda, the certificate's
vector, refinement and the condition, and the task returns lambda and the year's diagnostics together. Larger
years are solved in rounds of a join and a sum over the cells, which no task gathers. A year that breaks the
numerical policy is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.functions.keep import dropped, kept
from flowmill.functions.safe import divide

EPS = 2.0**-52
#: Largest system for one task: the matrix, its factors and the cells as received take about
#: 5 x 8 n^2 bytes, 2.6 GB.
MOST_INDUSTRIES = 8_000
#: Columns of the published diagnostics, in their order (fixed values).
TEXTS = ("system_orientation", "matrix_scope", "rcond_norm", "certificate_type", "lambda_fingerprint")
COUNTS = ("total_dimension", "productive_dimension", "refinement_count")
FIGURES = ("machine_epsilon", "gamma_n", "forward_error_budget", "rcond_min", "max_backward_error", "refinement_trigger", "rcond", "absolute_residual_max", "eta_normwise", "berr_componentwise", "sensitivity_estimate", "forward_error_bound")
BLOCKS = (
    "coefficient_count", "coefficient_zero_count", "coefficient_negative_count", "coefficient_nonfinite_count", "coefficient_min", "coefficient_max",
    "gross_output_count", "gross_output_zero_count", "gross_output_nonfinite_count", "gross_output_min", "gross_output_max",
    "labour_zero_count", "labour_negative_count", "labour_nonfinite_count", "labour_min", "labour_max", "lambda_zero_count", "lambda_negative_count", "lambda_nonfinite_count", "lambda_min", "lambda_max",
)
CERTIFIED = ("certificate_rcond", "certificate_margin", "certificate_ratio_upper", "certificate_roundoff_bound_max")
COLUMNS = ("method", "year", *TEXTS, *COUNTS, *FIGURES, *BLOCKS, *CERTIFIED)
ORIENTATION, SCOPE, NORM = "t(I - C)[productive, productive] %*% lambda = direct_labour", "productive_block", "infinity"
NONNEGATIVE, SIGNED = "productivity_nonnegative", "absolute_convergence_signed"
#: What a task returns for a year, besides the method; ``status`` is ``ok`` or what broke the policy.
DIAGNOSTICS = "year int, " + ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} int" for c in COUNTS), *(f"{c} {'long' if c.endswith('_count') else 'double'}" for c in (*FIGURES, *BLOCKS, *CERTIFIED)), "status string"])
NAMES = [f.split()[0] for f in DIAGNOSTICS.split(", ")]
INDUSTRY = ["year", "country", "sector"]


def input_flows(flows: DataFrame, depreciation: DataFrame | None, allowed_missing: str | None = None) -> DataFrame:
    """Intermediate flows plus depreciation: one sum by cell over both, with partial sums. A NULL depreciation
    is 0 only where declared."""
    z = flows.where("kind = 'industry'").select("year", "o_country", "o_sector", "d_country", "d_sector", "value")
    if depreciation is None:
        return z
    keys = ["year", "o_country", "o_sector", "d_country", "d_sector"]
    bad = F.col("value").isNull() & ~(F.expr(allowed_missing) if allowed_missing else F.lit(False))
    dep = depreciation.select(*keys, F.lit(0.0).alias("flow"), F.coalesce("value", F.lit(0.0)).alias("dep"), bad.alias("bad"))
    both = z.select(*keys, F.coalesce("value", F.lit(0.0)).alias("flow"), F.lit(0.0).alias("dep"), F.lit(False).alias("bad")).unionByName(dep)
    sums = both.groupBy(*keys).agg((F.sum("flow") + F.sum("dep")).alias("value"), F.bool_or("bad").alias("bad"))
    return sums.select(*keys, F.when(F.col("bad"), F.raise_error(F.lit("missing depreciation")).cast("double")).otherwise(F.col("value")).alias("value"))


def zero_output_scan(inputs: DataFrame, output: DataFrame) -> DataFrame:
    """Cells that go into columns without output: ``0/0`` or ``nonzero/0``. ``output``: (year,
    country, sector, x)."""
    x = output.select("year", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"), "x")
    hit = inputs.join(x, ["year", "d_country", "d_sector"], "left").where("coalesce(x, 0) = 0")
    return hit.withColumn("class", F.when(F.col("value") == 0, "0/0").otherwise("nonzero/0"))


def coefficients(inputs: DataFrame, output: DataFrame, productive) -> DataFrame:
    """a = input / output of the destination, on the productive block; columns without output drop
    out, which is their 0. ``productive``: function of a sector column."""
    x = output.select("year", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"), "x").where("x > 0")
    block = inputs.where(productive(F.col("o_sector")) & productive(F.col("d_sector")))
    return block.join(x, ["year", "d_country", "d_sector"]).select("year", "o_country", "o_sector", "d_country", "d_sector", (F.col("value") / F.col("x")).alias("a"))


def direct_labour(accounts: DataFrame, hours: str, output: str, productive) -> DataFrame:
    """(year, country, sector, x, l): hours per unit of output, 0 where both are 0."""
    own = F.when(productive(F.col("sector")), F.col(hours)).otherwise(F.lit(0.0))
    return accounts.select("year", "country", "sector", F.col(output).alias("x"), divide(own, F.col(output), "zero_if_both_zero").alias("l"), productive(F.col("sector")).alias("productive"))


# ---------------------------------------------------------------- dense algebra of a year


def policy(n: int) -> dict[str, float]:
    """Numerical limits for a system of size n."""
    gamma, budget = n * EPS / (1 - n * EPS), 1e-8
    return {"machine_epsilon": EPS, "gamma_n": gamma, "forward_error_budget": budget, "rcond_min": gamma / budget, "max_backward_error": 8 * gamma, "refinement_trigger": 64 * EPS}


MOST_REFINEMENTS = 2


class Factors:
    """A = P'LU with partial pivoting, by halving the columns, so that nearly all work is matrix products.

    Factors are kept, so every further right-hand side, of A or of A', costs n^2.
    """

    SMALL = 32

    def __init__(self, a: np.ndarray):
        self.lu, self.order = np.array(a, dtype=np.float64, order="C"), np.arange(len(a))
        self._factor(0, len(a))
        if not (np.diagonal(self.lu) != 0).all():
            raise np.linalg.LinAlgError("Singular matrix")

    def _swap(self, pivots: list[int], first: int, low: int, high: int) -> None:
        """Row exchanges of the columns from ``first`` on, in the columns from ``low`` to ``high``."""
        if high > low:
            at = np.arange(len(self.lu))
            for i, p in enumerate(pivots, first):
                at[[i, p]] = at[[p, i]]
            moved = np.flatnonzero(at != np.arange(len(at)))
            self.lu[moved, low:high] = self.lu[at[moved], low:high]

    def _factor(self, low: int, high: int) -> list[int]:
        a = self.lu
        if high - low <= self.SMALL:
            pivots = []
            for j in range(low, high):
                p = j + int(np.argmax(np.abs(a[j:, j])))
                pivots.append(p)
                if p != j:
                    a[[j, p], low:high] = a[[p, j], low:high]
                    self.order[[j, p]] = self.order[[p, j]]
                if a[j, j]:
                    a[j + 1 :, j] /= a[j, j]
                    a[j + 1 :, j + 1 : high] -= np.outer(a[j + 1 :, j], a[j, j + 1 : high])
            return pivots
        mid = (low + high) // 2
        left = self._factor(low, mid)
        self._swap(left, low, mid, high)
        self._lower(low, mid, a[low:mid, mid:high])
        a[mid:, mid:high] -= a[mid:, low:mid] @ a[low:mid, mid:high]
        right = self._factor(mid, high)
        self._swap(right, mid, low, mid)
        return left + right

    def _lower(self, low: int, high: int, b: np.ndarray) -> None:
        """b := L^-1 b for the unit lower block of these rows."""
        if high - low <= self.SMALL:
            for i in range(1, high - low):
                b[i] -= self.lu[low + i, low : low + i] @ b[:i]
            return
        mid = (low + high) // 2
        self._lower(low, mid, b[: mid - low])
        b[mid - low :] -= self.lu[mid:high, low:mid] @ b[: mid - low]
        self._lower(mid, high, b[mid - low :])

    def _upper(self, low: int, high: int, b: np.ndarray) -> None:
        if high - low <= self.SMALL:
            for i in range(high - low - 1, -1, -1):
                b[i] = (b[i] - self.lu[low + i, low + i + 1 : high] @ b[i + 1 :]) / self.lu[low + i, low + i]
            return
        mid = (low + high) // 2
        self._upper(mid, high, b[mid - low :])
        b[: mid - low] -= self.lu[low:mid, mid:high] @ b[mid - low :]
        self._upper(low, mid, b[: mid - low])

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = np.array(b[self.order], dtype=np.float64).reshape(len(self.lu), -1)
        self._lower(0, len(x), x)
        self._upper(0, len(x), x)
        return x.reshape(b.shape)

    def solve_transposed(self, b: np.ndarray) -> np.ndarray:
        x, a, n = np.array(b, dtype=np.float64), self.lu, len(b)
        for i in range(n):
            x[i] = (x[i] - a[:i, i] @ x[:i]) / a[i, i]
        for i in range(n - 1, -1, -1):
            x[i] -= a[i + 1 :, i] @ x[i + 1 :]
        out = np.empty(n)
        out[self.order] = x
        return out

    def inverse_norm(self, rounds: int = 5) -> float:
        """An estimate of the infinity norm of A^-1, the 1-norm of its transpose, by Hager's method with Higham's alternating vector."""
        n = len(self.lu)
        x, best = np.full(n, 1 / n), 0.0
        for _ in range(rounds):
            y = self.solve_transposed(x)
            size = float(np.abs(y).sum())
            if size <= best:
                break
            best = size
            z = self.solve(np.where(y >= 0, 1.0, -1.0))
            j = int(np.argmax(np.abs(z)))
            if np.abs(z[j]) <= z @ x:
                break
            x = np.zeros(n)
            x[j] = 1.0
        wave = np.where(np.arange(n) % 2, -1.0, 1.0) * (1 + np.arange(n) / max(n - 1, 1))
        return max(best, float(2 * np.abs(self.solve_transposed(wave)).sum() / (3 * n)))


def certificate(c: np.ndarray, z: np.ndarray | None = None, rcond: float | None = None) -> dict:
    """z solves (I - |C|)' z = 1. z > 0 and a bound below 1 of |C|'z over z, rounding included, show that the series
    converges. ``z`` and ``rcond``: those of the solve, whose system this is if C >= 0."""
    n, size = len(c), c if (c >= 0).all() else np.abs(c)
    out = {"certificate_type": NONNEGATIVE if size is c else SIGNED, "certificate_rcond": rcond, "certificate_margin": -np.inf, "certificate_ratio_upper": np.inf, "certificate_roundoff_bound_max": np.inf}
    if z is None:
        try:
            m = (np.eye(n) - size).T
            z = Factors(m).solve(np.ones(n))
        except np.linalg.LinAlgError:
            return out | {"certificate_rcond": 0.0}
        out["certificate_rcond"] = float(1 / (np.abs(m).sum(1).max() * np.abs(z).max()))
    if not (np.isfinite(z).all() and (z > 0).all()):
        return out
    reached, k = size.T @ z, n + 2
    bound = k * EPS / (1 - k * EPS) * (z + reached)
    return out | {"certificate_margin": float((z - reached - bound).min()), "certificate_ratio_upper": float(((reached + bound) / z).max()), "certificate_roundoff_bound_max": float(bound.max())}


def fingerprint(labels: list[str], lam: np.ndarray) -> str:
    """MD5 of the lines ``label<TAB>%.17g``."""
    return hashlib.md5("\n".join(f"{a}\t{b:.17g}" for a, b in zip(labels, lam)).encode()).hexdigest()


def year_fingerprints(lam: DataFrame, value: str) -> DataFrame:
    """(year, mark): the fingerprint of each year's values in label order. One value a label and year, so a group is
    of label size. Numbers are written as C writes them, which Spark's own format doesn't."""

    @F.pandas_udf("string")
    def digits(v: pd.Series) -> pd.Series:
        return v.map(lambda x: f"{x:.17g}")

    line = F.concat_ws("\t", F.concat_ws(".", "country", "sector"), digits(F.col(value)))
    rows = lam.select("year", F.struct("country", "sector", line.alias("line")).alias("at"))
    return rows.groupBy("year").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda r: r["line"]), "\n")).alias("mark"))


def verdict(d: dict) -> str:
    """``ok``, or the first limit that the figures break."""
    if not d["rcond"] >= d["rcond_min"]:
        return "condition"
    if not (max(d["eta_normwise"], d["berr_componentwise"]) <= d["max_backward_error"] and d["forward_error_bound"] <= d["forward_error_budget"]):
        return "backward error"
    return "ok" if d["certificate_margin"] > 0 and d["certificate_ratio_upper"] < 1 else "certificate"


def solve_block(c: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, dict]:  # noqa: E741
    """Solution of (I - C)' lambda = l with refinement, errors and certificate.

    C >= 0, the usual case: one factorisation by LAPACK with two right-hand sides gives lambda and the certificate's
    vector, whose largest value is the inverse's norm. Only refinement, which a small error doesn't call for, needs
    stored factors then. With negative cells the factors are stored at once: they give lambda, the
    norm's estimate and refinement, and the certificate, of another system, takes its own.
    """
    n = len(l)
    p, m = policy(n), (np.eye(n) - c).T
    positive = bool((c >= 0).all())
    factors = None if positive else Factors(m)
    both = np.linalg.solve(m, np.column_stack([l, np.ones(n)])) if positive else factors.solve(np.asarray(l, dtype=np.float64)[:, None])
    lam, z = both[:, 0].copy(), both[:, 1] if positive else None
    size = np.abs(m)
    norm = float(size.sum(1).max())
    # If C >= 0 and the series converges, the inverse is not negative and its row sums are z.
    if positive and (z > 0).all():
        inverse = float(z.max())
    else:
        factors = factors or Factors(m)
        inverse = factors.inverse_norm()
    rcond = float(1 / (norm * inverse))

    def errors(v):
        r = m @ v - l
        bottom, most = norm * np.abs(v).max() + np.abs(l).max(), float(np.abs(r).max())
        each = size @ np.abs(v) + np.abs(l)
        share = np.where(each > 0, np.abs(r) / np.where(each > 0, each, 1), np.where(r != 0, np.inf, 0.0))
        return r, most, (most / bottom if bottom else (0.0 if most == 0 else np.inf)), float(share.max())

    r, most, eta, comp = errors(lam)
    done = 0
    while max(eta, comp) > p["refinement_trigger"] and done < MOST_REFINEMENTS:
        factors = factors or Factors(m)
        lam = lam - factors.solve(r)
        done += 1
        r, most, eta, comp = errors(lam)
    out = p | {"rcond": rcond, "refinement_count": done, "absolute_residual_max": most, "eta_normwise": float(eta), "berr_componentwise": comp, "sensitivity_estimate": float(eta / rcond), "forward_error_bound": float(eta / rcond)}
    out |= certificate(c, z, rcond if positive else None)
    return lam, out | {"status": verdict(out)}


def counted(name: str, v: np.ndarray, sign: bool = True, extra_zeros: int = 0) -> dict:
    """Counts and extremes of an array that stands for ``extra_zeros`` further cells of 0."""
    v = v.ravel()
    low, high = (float(v.min()), float(v.max())) if v.size else (0.0, 0.0)
    if extra_zeros:
        low, high = min(low, 0.0), max(high, 0.0)
    out = {f"{name}_zero_count": int((v == 0).sum()) + extra_zeros, f"{name}_nonfinite_count": int((~np.isfinite(v)).sum()), f"{name}_min": low, f"{name}_max": high}
    return out | ({f"{name}_negative_count": int((v < 0).sum())} if sign else {})


# ---------------------------------------------------------------- a year as a grouped task


def numbered(coeffs: DataFrame, labour: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coefficients as (year, i, j, a) and labour as (y, country, sector, i, x, l, productive): ``i`` numbers a
    year's productive industries in label order from 0, and is null off the block."""
    right = labelled(labour)
    if not {"i", "j"} <= set(coeffs.columns):
        labels = right.where("i is not null")
        ends = [labels.select("year", F.col("country").alias(f"{end}_country"), F.col("sector").alias(f"{end}_sector"), F.col("i").alias(k)) for end, k in (("o", "i"), ("d", "j"))]
        coeffs = coeffs.join(ends[0], ["year", "o_country", "o_sector"]).join(ends[1], ["year", "d_country", "d_sector"])
    return coeffs.select("year", "i", "j", "a"), right.select(F.col("year").alias("y"), "country", "sector", "i", "x", "l", "productive")


def labelled(labour: DataFrame) -> DataFrame:
    """``labour`` with ``i``; a table that has it stays as it is."""
    if "i" in labour.columns:
        return labour
    place = F.row_number().over(W.partitionBy("year", "productive").orderBy("country", "sector")) - 1
    return labour.withColumn("i", F.when(F.col("productive"), place))


def system(inputs: DataFrame, labour: DataFrame) -> DataFrame:
    """The productive block as (year, o_country, o_sector, d_country, d_sector, i, j, a): every cell meets the labels
    twice, for its row and for its column with the output it is divided by. ``labour``: from ``labelled``."""
    labels = labour.where("i is not null")
    rows = labels.select("year", F.col("country").alias("o_country"), F.col("sector").alias("o_sector"), "i")
    columns = labels.where("x > 0").select("year", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"), F.col("i").alias("j"), "x")
    cells = inputs.join(columns, ["year", "d_country", "d_sector"]).join(rows, ["year", "o_country", "o_sector"])
    return cells.select("year", "o_country", "o_sector", "d_country", "d_sector", "i", "j", (F.col("value") / F.col("x")).alias("a"))


def matrix(cells: pd.DataFrame, n: int) -> np.ndarray:
    """The dense matrix of (i, j, a) cells; cells at one place add up."""
    flat = cells["i"].to_numpy(dtype=np.int64) * n + cells["j"].to_numpy(dtype=np.int64)
    return np.bincount(flat, weights=cells["a"].to_numpy(dtype=np.float64), minlength=n * n).reshape(n, n) if n else np.zeros((0, 0))


def solved_block(c: np.ndarray, l: np.ndarray, year) -> tuple[np.ndarray, dict]:  # noqa: E741
    """``solve_block``; a singular system is an error that names the year."""
    if not (np.isfinite(c).all() and np.isfinite(l).all()):
        raise ValueError(f"year {year}: coefficients or labour are not finite")
    try:
        return solve_block(c, l)
    except np.linalg.LinAlgError as e:
        raise ValueError(f"year {year}: the system is singular") from e


def refusal(year, d: dict) -> str:
    return f"year {year}: the solve is rejected by its {d['status']}: " + ", ".join(f"{k} {d[k]}" for k in ("rcond", "eta_normwise", "forward_error_bound", "certificate_ratio_upper"))


SOLUTION = f"year int, country string, sector string, lam double, d struct<{', '.join(f.replace(' ', ': ', 1) for f in DIAGNOSTICS.split(', '))}>"


def dense(cells: DataFrame, right: DataFrame, checked: bool) -> DataFrame:
    """Lambda rows, and one row of diagnostics in ``d``, of every year: one task a year."""

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = b.sort_values(["country", "sector"], ignore_index=True).assign(lam=0.0, d=None)
        block = rows[rows["productive"]]
        if len(block):
            year, left, n = int(block["y"].iloc[0]), block["l"].to_numpy(), len(block)
            c = matrix(a, n)
            lam, d = solved_block(c, left, year)
            if checked and d["status"] != "ok":
                raise ValueError(refusal(year, d))
            if not np.isfinite(lam).all():
                raise ValueError(f"year {year}: labour values are not finite")
            rows.loc[block.index, "lam"] = lam
            whole, x = rows["lam"].to_numpy(), rows["x"].to_numpy(dtype=np.float64, na_value=np.nan)
            d |= {"year": year, "system_orientation": ORIENTATION, "matrix_scope": SCOPE, "rcond_norm": NORM, "total_dimension": len(rows), "productive_dimension": n, "coefficient_count": len(rows) ** 2, "gross_output_count": len(rows)}
            d |= counted("coefficient", c, extra_zeros=len(rows) ** 2 - n * n) | counted("gross_output", x, sign=False) | counted("labour", rows["l"].to_numpy()) | counted("lambda", whole)
            d["lambda_fingerprint"] = fingerprint([f"{u}.{v}" for u, v in zip(rows["country"], rows["sector"])], whole)
            told = {"y": year, "d": {k: d[k] for k in NAMES}}
            rows = pd.DataFrame({k: pd.Series([*rows[k], told.get(k)], dtype=object) for k in ("y", "country", "sector", "lam", "d")})
        return rows.rename(columns={"y": "year"})[["year", "country", "sector", "lam", "d"]]

    return cells.groupBy("year").cogroup(right.groupBy("y")).applyInPandas(one, SOLUTION)


# ---------------------------------------------------------------- years too large for a task


def in_rounds(cells: DataFrame, right: DataFrame, checked: bool = True, most_rounds: int = 2_000) -> DataFrame:
    """The same table as ``dense`` for years of any size, by the series lambda = l + C'l + C'C'l + ...

    A round is one join of the cells with the last terms, on row numbers, and one sum by column number; terms are
    written, cells are written once. Beside lambda runs z = 1 + |C|'1 + ..., whose last steps give a
    ratio r < 1 with |C|'z <= r z; in the norm weighted by z each term is at most r times the one before,
    so what is left of the series is at most r / (1 - r) of the last term. Rounds go on until, in every year, that is
    below n units of rounding of lambda's largest value and each last term below as much of its own lambda, as the limits
    of the backward errors ask; a year whose ratio doesn't fall below 1 is refused.
    """
    left = kept(right.where("i is not null").select(F.col("y").alias("year"), "i", F.col("l").cast("double").alias("l")), "labour")
    cells = kept(cells.repartition("year", "i"), "cells")
    sums = kept(left.select("year", "i", F.col("l").alias("lam"), F.col("l").alias("term"), F.lit(1.0).alias("z"), F.lit(1.0).alias("unit")), "series")
    for n in range(most_rounds):
        ahead = cells.join(sums.select("year", "i", "term", "unit"), ["year", "i"]).groupBy("year", F.col("j").alias("i")).agg(F.sum(F.col("a") * F.col("term")).alias("term"), F.sum(F.abs("a") * F.col("unit")).alias("unit"))
        ahead = sums.select("year", "i", "lam", "z", F.col("unit").alias("before")).join(ahead, ["year", "i"], "left").fillna(0.0, ["term", "unit"])
        new = kept(ahead.select("year", "i", (F.col("lam") + F.col("term")).alias("lam"), "term", (F.col("z") + F.col("unit")).alias("z"), "unit"), "series")
        dropped(sums)
        sums = new
        # |C|'z = z - 1 + the next unit term, which is at most this one's share of z times the last ratio.
        told = sums.groupBy("year").agg(F.max((F.col("z") - 1) / (F.col("z") - F.col("unit"))).alias("ratio"), F.max(F.abs("term") / (F.col("z") - F.col("unit"))).alias("last"), F.max("z").alias("height"), F.max(F.abs("lam")).alias("size"), F.max("unit").alias("unit"), F.coalesce(F.max(F.abs("term") / F.abs(F.nullif("lam", F.lit(0.0)))), F.lit(0.0)).alias("own"), F.count("*").alias("n")).collect()
        bad = [r.year for r in told if not np.isfinite([r.ratio, r.last, r.size]).all()]
        if bad or n + 1 == most_rounds:
            raise ValueError(f"years {bad or [r.year for r in told]}: the series does not converge")
        if all(r.ratio < 1 and r.ratio / (1 - r.ratio) * r.last * r.height <= r.n * EPS * r.size and r.unit <= r.n * EPS * r.height and r.own <= r.n * EPS for r in told):
            break
    lam = right.join(sums.select(F.col("year").alias("y"), "i", "lam", "z"), ["y", "i"], "left").withColumns({"lam": F.coalesce("lam", F.lit(0.0)), "z": F.coalesce("z", F.lit(0.0))})
    lam = kept(lam, "lambda")
    found = measured(cells, lam)
    if checked:
        bad = found.where("status <> 'ok'").collect()
        if bad:
            raise ValueError("; ".join(refusal(r.year, r.asDict()) for r in bad))
    fields = [F.col(c) for c in NAMES]
    rows = lam.select(F.col("y").cast("int").alias("year"), "country", "sector", "lam", F.lit(None).cast(SOLUTION.split(", d ", 1)[1]).alias("d"))
    return rows.unionByName(found.select("year", F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("sector"), F.lit(None).cast("double").alias("lam"), F.struct(*fields).alias("d")))


def measured(cells: DataFrame, lam: DataFrame) -> DataFrame:
    """Diagnostics of years of any size, by aggregation: ``lam``: (y, country, sector, i, x, l, lam, z). The inverse's norm is
    at most z's largest value, so the condition is never told better than it is."""
    v = lam.where("i is not null").select(F.col("y").alias("year"), "i", "l", "lam", "z")
    c = cells.withColumn("own", F.col("i") == F.col("j"))
    reached = c.join(v.select("year", "i", "lam", "z"), ["year", "i"]).groupBy("year", F.col("j").alias("i")).agg(
        F.sum(F.col("a") * F.col("lam")).alias("in_lam"), F.sum(F.abs("a") * F.abs("lam")).alias("in_size"), F.sum(F.abs("a") * F.col("z")).alias("in_z"), F.sum(F.when(~F.col("own"), F.abs("a")).otherwise(0.0)).alias("off"),
        F.sum(F.when(F.col("own"), F.col("a")).otherwise(0.0)).alias("diagonal"), F.count_if(F.col("a") < 0).alias("negative"), F.count_if(F.col("a") != 0).alias("filled"), F.min("a").alias("least"), F.max("a").alias("most"),
    )
    rows = v.join(reached, ["year", "i"], "left").fillna(0.0, ["in_lam", "in_size", "in_z", "off", "diagonal"]).fillna(0, ["negative", "filled"])
    r = F.abs(F.col("lam") - F.col("in_lam") - F.col("l"))
    each = F.abs("lam") * F.abs(1 - F.col("diagonal")) + F.col("in_size") - F.abs("diagonal") * F.abs("lam") + F.abs("l")
    n = F.count("*")
    gamma = (n + 2) * EPS / (1 - (n + 2) * EPS)
    rows = rows.withColumns({"r": r, "share": F.when(each > 0, r / each).otherwise(F.when(r > 0, float("inf")).otherwise(0.0)), "row": F.abs(1 - F.col("diagonal")) + F.col("off")})
    by = rows.groupBy("year").agg(
        n.cast("int").alias("productive_dimension"), F.max("r").alias("absolute_residual_max"), F.max("share").alias("berr_componentwise"), F.max("row").alias("norm"), F.max(F.abs("lam")).alias("top"), F.max(F.abs("l")).alias("l_top"), F.max("z").alias("z_top"),
        F.min(F.col("z") - F.col("in_z")).alias("slack"), F.max(F.col("in_z") / F.col("z")).alias("ratio"), F.max(F.col("z") + F.col("in_z")).alias("reach"), F.max((F.col("z") + F.col("in_z")) / F.col("z")).alias("share_reach"), gamma.alias("gamma"),
        F.sum("negative").alias("coefficient_negative_count"), F.sum("filled").alias("filled"), F.min("least").alias("least"), F.max("most").alias("most"),
    )
    whole = lam.groupBy(F.col("y").alias("year")).agg(
        F.count("*").cast("int").alias("total_dimension"), F.count_if(F.col("x") == 0).alias("gross_output_zero_count"), F.min("x").alias("gross_output_min"), F.max("x").alias("gross_output_max"),
        F.count_if(~(F.abs("x") < float("inf")) | F.col("x").isNull()).alias("gross_output_nonfinite_count"),
        *(f(name, c) for name, c in (("labour", "l"), ("lambda", "lam")) for f in (lambda k, x: F.count_if(F.col(x) == 0).alias(f"{k}_zero_count"), lambda k, x: F.count_if(F.col(x) < 0).alias(f"{k}_negative_count"), lambda k, x: F.min(x).alias(f"{k}_min"), lambda k, x: F.max(x).alias(f"{k}_max"))),
    )
    marks = year_fingerprints(lam.select(F.col("y").alias("year"), "country", "sector", "lam"), "lam").withColumnRenamed("mark", "lambda_fingerprint")
    both = by.join(whole, "year").join(marks, "year")
    size = F.col("productive_dimension")
    limits = {"machine_epsilon": F.lit(EPS), "gamma_n": size * EPS / (1 - size * EPS), "forward_error_budget": F.lit(1e-8)}
    both = both.withColumns(limits).withColumns({"rcond_min": F.col("gamma_n") / F.col("forward_error_budget"), "max_backward_error": 8 * F.col("gamma_n"), "refinement_trigger": F.lit(64 * EPS), "rcond": 1 / (F.col("norm") * F.col("z_top"))})
    bottom = F.col("norm") * F.col("top") + F.col("l_top")
    both = both.withColumn("eta_normwise", F.when(bottom > 0, F.col("absolute_residual_max") / bottom).otherwise(0.0)).withColumn("sensitivity_estimate", F.col("eta_normwise") / F.col("rcond"))
    count = F.col("total_dimension").cast("long") * F.col("total_dimension")
    implied = count > F.col("filled")
    both = both.withColumns({
        "system_orientation": F.lit(ORIENTATION), "matrix_scope": F.lit(SCOPE), "rcond_norm": F.lit(NORM), "certificate_type": F.when(F.col("coefficient_negative_count") > 0, SIGNED).otherwise(NONNEGATIVE), "refinement_count": F.lit(0),
        "forward_error_bound": F.col("sensitivity_estimate"), "coefficient_count": count, "coefficient_zero_count": count - F.col("filled"), "coefficient_nonfinite_count": F.lit(0).cast("long"),
        "coefficient_min": F.when(implied, F.least(F.col("least"), F.lit(0.0))).otherwise(F.col("least")), "coefficient_max": F.when(implied, F.greatest(F.col("most"), F.lit(0.0))).otherwise(F.col("most")),
        "gross_output_count": F.col("total_dimension").cast("long"), "labour_nonfinite_count": F.lit(0).cast("long"), "lambda_nonfinite_count": F.lit(0).cast("long"), "certificate_rcond": F.col("rcond"),
        "certificate_margin": F.col("slack") - F.col("gamma") * F.col("reach"), "certificate_ratio_upper": F.col("ratio") + F.col("gamma") * F.col("share_reach"), "certificate_roundoff_bound_max": F.col("gamma") * F.col("reach"),
    })
    errors = (F.greatest("eta_normwise", "berr_componentwise") <= F.col("max_backward_error")) & (F.col("forward_error_bound") <= F.col("forward_error_budget"))
    status = F.when(~(F.col("rcond") >= F.col("rcond_min")), "condition").when(~errors, "backward error").when(~((F.col("certificate_margin") > 0) & (F.col("certificate_ratio_upper") < 1)), "certificate").otherwise("ok")
    return both.withColumns({"status": status, "year": F.col("year").cast("int")}).select(*NAMES)


# ---------------------------------------------------------------- the operator


def solution(coeffs: DataFrame, labour: DataFrame, checked: bool = True, limit: int = MOST_INDUSTRIES) -> DataFrame:
    """Rows of lambda (``d`` null; 0 off the productive block) and one row of diagnostics a year (``d``), from one
    pass of the cells. ``checked``: a year that breaks the numerical policy is an error. Years of more than
    ``limit`` productive industries are solved in rounds."""
    cells, right = numbered(coeffs, labour)
    sizes = {r.y: r["count"] for r in right.where("productive").groupBy("y").count().collect()}
    large = [y for y, n in sizes.items() if n > limit]
    if not large:
        return dense(cells, right, checked)
    small = dense(cells.where(~F.col("year").isin(large)), right.where(~F.col("y").isin(large)), checked)
    return small.unionByName(in_rounds(cells.where(F.col("year").isin(large)), right.where(F.col("y").isin(large)), checked))


def lambda_of(solved: DataFrame) -> DataFrame:
    return solved.where("d is null").select("year", "country", "sector", "lam")


def diagnostics_of(solved: DataFrame) -> DataFrame:
    return solved.where("d is not null").select("d.*")


def solve(coeffs: DataFrame, labour: DataFrame, checked: bool = True, limit: int = MOST_INDUSTRIES) -> DataFrame:
    """(year, country, sector, lam)."""
    return lambda_of(solution(coeffs, labour, checked, limit))


def diagnose(coeffs: DataFrame, labour: DataFrame, limit: int = MOST_INDUSTRIES) -> DataFrame:
    """One row of diagnostics for each year, of refused ones too."""
    return diagnostics_of(solution(coeffs, labour, False, limit))


# ---------------------------------------------------------------- the published diagnostics


def for_method(diagnostics: DataFrame, method: str) -> DataFrame:
    """The columns that are published, in their order."""
    return diagnostics.withColumn("method", F.lit(method)).select(*COLUMNS)


def contract_errors(published: DataFrame, method: str | None = None, years: tuple[int, ...] = ()) -> DataFrame:
    """(method, year, problem) of a published table that breaks its contract; empty if it is sound."""
    near = lambda a, b: F.abs(a - b) <= 128 * EPS * F.greatest(F.abs(b), F.lit(2.0**-1022))
    col, n = F.col, F.col("productive_dimension")
    gamma = n * EPS / (1 - n * EPS)
    numbers = [c for c in COLUMNS if c not in ("method", "year", *TEXTS)]
    rules = {
        "missing or infinite": ~(col("method").isNull() | col("year").isNull() | (col("method") == "") | F.exists(F.array(*TEXTS), lambda t: t.isNull()) | F.exists(F.array(*(col(c).cast("double") for c in numbers)), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))),
        "labels": (col("system_orientation") == ORIENTATION) & (col("matrix_scope") == SCOPE) & (col("rcond_norm") == NORM) & col("lambda_fingerprint").rlike("^[0-9a-f]{32}$"),
        "dimensions": (n >= 1) & (col("total_dimension") >= n) & (col("coefficient_count") == col("total_dimension").cast("long") * col("total_dimension")) & (col("gross_output_count") == col("total_dimension")),
        "policy": near(col("machine_epsilon"), F.lit(EPS)) & near(col("gamma_n"), gamma) & near(col("forward_error_budget"), F.lit(1e-8)) & near(col("rcond_min"), gamma / 1e-8) & near(col("max_backward_error"), 8 * gamma) & near(col("refinement_trigger"), F.lit(64 * EPS)) & col("refinement_count").between(0, MOST_REFINEMENTS),
        "counts": (col("coefficient_zero_count") + col("coefficient_negative_count") <= col("coefficient_count")) & (F.greatest(*(col(f"{k}_count") for k in ("gross_output_zero", "labour_zero", "labour_negative", "lambda_zero", "lambda_negative"))) <= col("total_dimension"))
        & (F.least(F.lit(0), *(col(c) for c in COLUMNS if c.endswith("_count"))) >= 0) & (sum((col(f"{k}_nonfinite_count") for k in ("coefficient", "gross_output", "labour", "lambda")), F.lit(0)) == 0),
        "errors": (F.greatest("eta_normwise", "berr_componentwise") <= col("max_backward_error")) & (F.least("eta_normwise", "berr_componentwise", "absolute_residual_max", "sensitivity_estimate", "forward_error_bound") >= 0) & (col("forward_error_bound") <= col("forward_error_budget"))
        & near(col("sensitivity_estimate"), col("eta_normwise") / col("rcond")) & near(col("forward_error_bound"), col("sensitivity_estimate")),
        "condition": (col("rcond") > 0) & (col("rcond") <= 1) & (col("rcond") >= col("rcond_min")) & (col("certificate_rcond") > 0) & (col("certificate_rcond") <= 1),
        "certificate": (col("certificate_margin") > 0) & (col("certificate_ratio_upper") >= 0) & (col("certificate_ratio_upper") < 1) & (col("certificate_roundoff_bound_max") >= 0) & (col("certificate_type") == F.when(col("coefficient_negative_count") > 0, SIGNED).otherwise(NONNEGATIVE)),
        "method": col("method") == method if method else F.lit(True),
        "year": col("year").isin(*years) if years else F.lit(True),
    }
    if tuple(published.columns) != COLUMNS:
        raise ValueError(f"diagnostics have other columns: {sorted(set(published.columns) ^ set(COLUMNS)) or 'in another order'}")
    told = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items())), lambda p: p.isNotNull())
    out = published.select("method", "year", F.explode(told).alias("problem"))
    twice = published.groupBy("method", "year").count().where("count > 1").select("method", "year", F.lit("repeated").alias("problem"))
    out = out.unionByName(twice)
    if years:
        want = published.sparkSession.createDataFrame([(y,) for y in years], "year int")
        absent = want.join(published.select(F.col("year").cast("int").alias("year")).distinct(), "year", "left_anti")
        out = out.unionByName(absent.select(F.lit(method).cast("string").alias("method"), F.col("year").cast(published.schema["year"].dataType).alias("year"), F.lit("absent").alias("problem")))
    return out


def refuse(problems: DataFrame) -> None:
    """An error with the first ten problems, if there are any."""
    bad = problems.orderBy("method", "year", "problem").limit(10).collect()
    if bad:
        raise ValueError("diagnostics break their contract: " + "; ".join(f"{r.method}/{r.year} {r.problem}" for r in bad))


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Published diagnostics with new rows, in the order of methods and years; a repeated method-year or an unsound row aborts."""
    both = old.unionByName(new)
    refuse(contract_errors(both))
    return both.orderBy("method", "year")


def loaded(spark, path: str, method: str, years: tuple[int, ...] = ()) -> DataFrame:
    """Published diagnostics from a ``;`` separated file with decimal commas, checked against the contract."""
    number = lambda c: F.regexp_replace(c, ",", ".").cast("double" if not c.endswith("_count") and c not in COUNTS else "long")
    rows = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    if tuple(rows.columns) != COLUMNS:
        raise ValueError("diagnostics have other columns")
    out = rows.select("method", F.col("year").cast("int").alias("year"), *TEXTS, *(number(c).alias(c) for c in COLUMNS if c not in ("method", "year", *TEXTS)))
    refuse(contract_errors(out, method, years))
    return out
