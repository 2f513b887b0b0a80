"""The ledger of scientific checks: an independent recomputation, differences and tolerances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.operators.capital import exact_set_errors
from flowmill.operators.leontief import contract_errors, for_method, year_fingerprints

EPS = 2.0**-52


def gamma(k: Column) -> Column:
    return k * EPS / 2 / (1 - k * EPS / 2)


def check(df: DataFrame, check_id: str, scope: str, difference: Column, scale: Column, tolerance: Column | float) -> DataFrame:
    """A ledger row: cells, largest difference, largest scaled difference, tolerance, status."""
    t = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    d = F.coalesce(F.abs(difference), F.lit(float("inf")))
    return df.agg(
        F.count("*").alias("n"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs"), F.coalesce(F.max(d / F.greatest(F.lit(1.0), F.abs(scale))), F.lit(0.0)).alias("max_scaled"),
        F.coalesce(F.max(t), F.lit(0.0)).alias("tolerance"), F.when(F.coalesce(F.max(F.when(d > t, 1).otherwise(0)), F.lit(0)) == 1, "failed").otherwise("passed").alias("status"),
    ).select(F.lit(check_id).alias("check_id"), F.lit(scope).alias("scope"), "n", "max_abs", "max_scaled", "tolerance", "status")


def structure(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Complete, unique and non-empty labels."""
    bad = reduce(Column.__or__, [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in keys])
    n = df.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*keys)).alias("u"), F.count_if(bad).alias("b"))
    return check(n, "structure", "labels", F.abs(F.col("n") - expected) + (F.col("n") - F.col("u")) + F.col("b"), F.lit(1), 0.0)


def recomputed(sectors: DataFrame, published: DataFrame, value: str, world: str = "WWW") -> DataFrame:
    """Country sums recomputed in SQL text against published ones, within the summation bound."""
    both = sectors.sparkSession.sql(
        """select s.*, p.got from (select year, country, sum(v) as want, sum(abs(v)) as size, count(v) as k from {sectors} group by year, country) s
        full join {published} p on s.year = p.year and s.country = p.country where p.country is null or p.country <> {world}""",
        sectors=sectors.select("year", "country", F.col(value).alias("v")), published=published.select("year", "country", F.col(value).alias("got")), world=world,
    )
    return check(both, "recomputed_country", value, F.col("want") - F.col("got"), F.col("want"), _summation_bound())


def recomputed_world(sectors: DataFrame, published: DataFrame, value: str, world: str = "WWW") -> DataFrame:
    """World sums recomputed from sectors against the published ones."""
    want = sectors.groupBy("year").agg(F.sum(value).alias("want"), F.sum(F.abs(value)).alias("size"), F.count(value).alias("k"))
    both = want.join(published.where(F.col("country") == world).select("year", F.col(value).alias("got")), "year", "full")
    return check(both, "recomputed_world", value, F.col("want") - F.col("got"), F.col("want"), _summation_bound())


def _summation_bound() -> Column:
    return 64 * EPS * F.greatest(F.lit(1.0), F.abs("want")) + 8 * gamma(F.col("k").cast("double")) * F.col("size")


def zero_diagonal(pairs: DataFrame, values: list[str]) -> DataFrame:
    d = reduce(Column.__add__, [F.abs(v) for v in values])
    return check(pairs.where("origin = destination"), "zero_diagonal", "bilateral", d, F.lit(1), 0.0)


def transfers_cancel(pairs: DataFrame, value: str = "transfers_productive_values") -> DataFrame:
    """The world sum of transfers is 0 in every year, within the rounding of its terms."""
    by = pairs.groupBy("year").agg(F.sum(value).alias("s"), F.sum(F.abs(value)).alias("size"), F.count("*").alias("k"))
    return check(by, "transfers_cancel", value, F.col("s"), F.col("size"), 1e-9 * F.greatest(F.lit(1.0), F.col("size")))


def column_sums(cells: DataFrame, totals: DataFrame, check_id: str) -> DataFrame:
    """Sums over origins equal the destination's total: (year, d_country, d_sector, total)."""
    keys = ["year", "d_country", "d_sector"]
    got = cells.groupBy(*keys).agg(F.sum("value").alias("got"))
    both = totals.join(got, keys, "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
    return check(both, check_id, "destination", F.col("got") - F.col("total"), F.col("total"), 1e-10 * F.greatest(F.lit(1.0), F.abs("total")))


def row_sums(valued: DataFrame, industries: DataFrame, column: str = "go_mv") -> DataFrame:
    """Sums over destinations equal the industry's gross output in values."""
    got = valued.groupBy("year", F.col("o_country").alias("country"), F.col("o_sector").alias("sector")).agg(F.sum("worth").alias("got"))
    both = industries.select("year", "country", "sector", column).join(got, ["year", "country", "sector"], "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
    return check(both, "row_sums", column, F.col("got") - F.col(column), F.col(column), 1e-9 * F.greatest(F.lit(1.0), F.abs(column)))


def in_range(df: DataFrame, value: str, low: float = 0.0) -> DataFrame:
    return check(df, "range", value, F.greatest(F.lit(low) - F.col(value), F.lit(0.0)), F.lit(1), 0.0)


def diagnostics_profile(diagnostics: DataFrame) -> DataFrame:
    """A method-year fails if its row says so or breaks the contract of published rows."""
    broken = contract_errors(for_method(diagnostics, "any")).select("year").distinct().withColumn("broken", F.lit(True))
    bad = F.when((F.col("status") == "ok") & F.col("broken").isNull(), 0.0).otherwise(1.0)
    return check(diagnostics.join(broken, "year", "left"), "diagnostics", "method-year", bad, F.lit(1), 0.0)


def ledger(*rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("status <> 'passed'")


def lambda_fingerprints(lam: DataFrame, published: DataFrame, column: str = "value_m_mv") -> DataFrame:
    """(year, status): whether labels and values of a year, each written with 17 digits, have the MD5 of the
    published ones."""
    own, theirs = year_fingerprints(lam, "lam"), year_fingerprints(published, column).withColumnRenamed("mark", "theirs")
    return own.join(theirs, "year", "full").select("year", F.when(F.col("mark").eqNullSafe(F.col("theirs")), "passed").otherwise("failed").alias("status"))


def round_trip(artifact: str, wanted: DataFrame, staged: DataFrame | None, keys: list[str], value: str) -> DataFrame:
    """(artifact, rows, missing, unexpected, different) of a staged result against what was computed; a
    result that wasn't staged lacks all its rows."""
    staged = wanted.limit(0) if staged is None else staged
    off = exact_set_errors(staged, wanted, keys, value)
    counts = off.agg(*(F.count_if(F.col("problem") == p).alias(p) for p in ("missing", "unexpected", "different")))
    return wanted.agg(F.lit(artifact).alias("artifact"), F.count("*").alias("n")).crossJoin(counts)  # one row each
