"""Statistics over results: price-value deviations, bilateral series, regional averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.operators.relational import exact_quantile, weighted_mean


def deviations(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", logs: bool = False) -> DataFrame:
    """Deviation measures of a from b over pairs where neither is 0, one aggregation per key:
    r, r2, MAD, MAWD (weights b), NVD, RMSPE, theta, cv, d. Undefined measures are NULL."""
    rows = pairs.where(f"{a} <> 0 and {b} <> 0").select(*keys, *((F.ln(F.col(c)) if logs else F.col(c).cast("double")).alias(n) for c, n in ((a, "x"), (b, "y"))))
    q = F.col("x") / F.col("y")
    off = F.abs(F.col("x") - F.col("y"))
    varies = (F.stddev_samp("x") > 0) & (F.stddev_samp("y") > 0)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(varies, F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))).alias("r"),
        F.avg(off / F.abs("y")).alias("mad"), F.try_divide(F.sum(off / F.abs("y") * F.col("y")), F.sum("y")).alias("mawd"),
        F.try_divide(F.sqrt(F.sum(off * off)), F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("nvd"), F.sqrt(F.avg((off / F.col("y")) * (off / F.col("y")))).alias("rmspe"),
        F.try_divide(F.stddev_samp(q), F.avg(q)).alias("cv"),
    )
    return out.withColumns({"r2": F.col("r") * F.col("r"), "theta": F.degrees(F.atan("cv")), "d": 2 * F.sin(F.atan("cv") / 2)})


def by_method(tables: dict[str, DataFrame]) -> DataFrame:
    """Results of several methods in one table with a method column."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("method", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def price_table(rows: DataFrame, methods: list[str], value: str = "value") -> DataFrame:
    """Values of methods side by side in millions with differences in per cent of the first."""
    wide = rows.groupBy("year", "country").pivot("method", methods).agg(F.sum(value))
    first = F.col(methods[0])
    return wide.select("year", "country", *((F.col(m) / 1e6).alias(m) for m in methods), *(F.try_divide(100 * (F.col(m) - first), first).alias(f"{m}_pct") for m in methods[1:]))


def pair_series(pairs: DataFrame, value: str = "transfers_values") -> DataFrame:
    """Net flow of each unordered pair of countries: a self-join with swapped keys."""
    back = pairs.select("year", F.col("destination").alias("origin"), F.col("origin").alias("destination"), F.col(value).alias("back"))
    return pairs.where("origin < destination").join(back, ["year", "origin", "destination"], "left").select("year", "origin", "destination", (F.col(value) - F.coalesce("back", F.lit(0.0))).alias("net"))


def rate_series(rows: DataFrame, value: str) -> DataFrame:
    """Negative rates are not meaningful and become NULL."""
    return rows.withColumn(value, F.when(F.col(value) < 0, F.lit(None).cast("double")).otherwise(F.col(value)))


def regional_average(rows: DataFrame, members: list[str], value: str, weight: str) -> DataFrame:
    return rows.where(F.col("country").isin(members)).groupBy("year").agg(weighted_mean(value, weight).alias(value))


def bundle_sums(rows: DataFrame, bundles: DataFrame, value: str, unit: float = 2e9) -> DataFrame:
    """Sums of sector bundles in a unit. ``bundles``: (sector, bundle)."""
    return rows.join(bundles, "sector").groupBy("year", "country", "bundle").agg((F.sum(value) / unit).alias(value))


def timing_summary(runs: DataFrame) -> DataFrame:
    """Median, least and most seconds of each strategy, exact at any number of runs."""
    return exact_quantile(runs, ["strategy"], "seconds", 0.5, "median")
