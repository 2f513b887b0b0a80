"""Turning provider tables into normalised long tables, and checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.operators.capital import exact_set_errors


def long_years(wide: DataFrame, keys: list[str], drop_code: str | None = "TOT", code: str = "code", prefix: str = "_") -> DataFrame:
    """One row per year from year columns; the total's rows are dropped."""
    years = [c for c in wide.columns if c.removeprefix(prefix).isdigit()]
    out = wide.unpivot(keys, years, "year", "value").withColumn("year", F.regexp_replace("year", f"^{prefix}", "").cast("int"))
    return out.where(F.col(code) != drop_code) if drop_code else out


def wide_variables(long: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("variable", variables).agg(F.first("value"))


def missing_as_zero(df: DataFrame, value: str, label: Column, expected_md5: str) -> DataFrame:
    """Missing cells become 0 only if their set is exactly the known one (by its fingerprint)."""
    lacking = df.where(F.col(value).isNull())
    got = lacking.agg(F.md5(F.array_join(F.sort_array(F.collect_set(label)), "\n")).alias("md5")).first().md5
    if got != expected_md5:
        raise ValueError(f"missing cells are not the known set ({got})")
    return df.withColumn(value, F.coalesce(value, F.lit(0.0)))


def normalised(df: DataFrame, scales: dict[str, float], marker: str = "normalised") -> DataFrame:
    """Source units to canonical units, exactly once: a marker column guards against a second time."""
    if marker in df.columns:
        raise ValueError("units are already normalised")
    return df.withColumns({c: F.col(c) * F.lit(s) for c, s in scales.items()}).withColumn(marker, F.lit(True))


def accounting_errors(flows: DataFrame, output: DataFrame, unit: float = 1.0) -> DataFrame:
    """Industries whose row sum differs from gross output by more than 1e-6 unit + 1e-8 of its size.
    ``output``: (year, country, sector, x)."""
    sums = flows.groupBy("year", F.col("o_country").alias("country"), F.col("o_sector").alias("sector")).agg(F.sum("value").alias("uses"))
    both = output.join(sums, ["year", "country", "sector"], "full")
    off = F.abs(F.coalesce("uses", F.lit(0.0)) - F.coalesce("x", F.lit(0.0)))
    return both.where(off > 1e-6 * unit + 1e-8 * F.abs(F.coalesce("x", F.lit(0.0)))).select("year", "country", "sector", "uses", "x")


def key_errors(df: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Repeated keys and missing or non-finite required values, as (problem, n)."""
    twice = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).withColumn("problem", F.lit("repeated key"))
    out = twice.select("problem", "n")
    for c in required:
        bad = df.where(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).agg(F.count("*").alias("n"))
        out = out.unionByName(bad.withColumn("problem", F.lit(f"{c}: not finite")).select("problem", "n"))
    return out.where("n > 0")


def disaggregated(totals: DataFrame, mapping: DataFrame, weights: DataFrame, value: str = "value") -> DataFrame:
    """Splits aggregate codes over their parts by weight shares. ``mapping``: (aggregated,
    disaggregated); ``weights``: (year, country, code, weight); an aggregate whose weights are all 0
    is split evenly."""
    parts = mapping.join(weights.withColumnRenamed("code", "disaggregated"), "disaggregated")
    w = W.partitionBy("year", "country", "aggregated")
    share = F.when(F.sum("weight").over(w) != 0, F.col("weight") / F.sum("weight").over(w)).otherwise(1 / F.count("*").over(w))
    shares = parts.withColumn("share", share).select("year", "country", "aggregated", "disaggregated", "share")
    return totals.withColumnRenamed("code", "aggregated").join(shares, ["year", "country", "aggregated"]).select("year", "country", F.col("disaggregated").alias("code"), (F.col(value) * F.col("share")).alias(value))


def reaggregated(df: DataFrame, mapping: DataFrame, value: str = "value") -> DataFrame:
    """Sums parts to their aggregate codes."""
    return df.join(mapping, F.col("code") == F.col("disaggregated")).groupBy("year", "country", F.col("aggregated").alias("code")).agg(F.sum(value).alias(value))


def with_mean_country(df: DataFrame, value: str, name: str = "MD") -> DataFrame:
    """Adds a synthetic country: the mean over countries by (year, sector, ktype)."""
    keys = [c for c in df.columns if c not in ("country", value)]
    return df.unionByName(df.groupBy(*keys).agg(F.avg(value).alias(value)).withColumn("country", F.lit(name)), allowMissingColumns=True)


def complete_countries(df: DataFrame, n_expected: int, exclude: list[str], value: str = "value") -> DataFrame:
    """Countries that have every cell and are not excluded."""
    ok = df.groupBy("country").agg(F.count(value).alias("n")).where(F.col("n") == n_expected).where(~F.col("country").isin(exclude))
    return df.join(ok.select("country"), "country", "left_semi")


def weighted_depreciation(rates: DataFrame, stocks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rates of aggregate sectors: parts' rates weighted by their stock (plain mean without stock)."""
    rows = rates.join(mapping, F.col("sector") == F.col("disaggregated")).join(stocks, ["year", "country", "sector", "ktype"], "left")
    s = F.coalesce("stock", F.lit(0.0))
    return rows.groupBy("year", "country", F.col("aggregated").alias("sector"), "ktype").agg(F.coalesce(F.try_divide(F.sum(F.col("rate") * s), F.sum(s)), F.avg("rate")).alias("rate"))


def euro_members(rates: DataFrame, members: DataFrame) -> DataFrame:
    """Members take the euro's rate from their first year. ``members``: (country, start)."""
    euro = rates.where("country = 'EUR'").select("year", F.col("rate").alias("euro"))
    joined = rates.join(members, "country", "left").join(euro, "year", "left")
    return joined.withColumn("rate", F.when(F.col("year") >= F.col("start"), F.col("euro")).otherwise(F.col("rate"))).select(*rates.columns)


def with_io_rows(long: DataFrame, io: DataFrame, rows: dict[str, str]) -> DataFrame:
    """Adds variables that stand as rows below a flow table: ``rows`` maps a row's label to the variable.
    ``long``: (year, country, code, variable, value)."""
    named = F.create_map(*(F.lit(x) for kv in rows.items() for x in kv))
    extra = io.where(F.col("o_sector").isin(list(rows))).groupBy("year", F.col("d_country").alias("country"), F.col("d_sector").alias("code"), named[F.col("o_sector")].alias("variable")).agg(F.sum("value").alias("value"))
    return long.unionByName(extra)


def negatives_apart(df: DataFrame, value: str, pinned: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Negative cells that differ from the pinned ones: (keys, problem)."""
    return exact_set_errors(df.where(F.col(value) < 0), pinned, keys, value, tolerance)
