"""Imputations for countries and the rest of the world (ROW) before labour values are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.functions.safe import divide

ROW = "ROW"


def replaced(country: str, columns: dict[str, Column]) -> dict[str, Column]:
    """withColumns argument: new values for one country only."""
    return {n: F.when(F.col("country") == country, c).otherwise(F.col(n)) for n, c in columns.items()}


def employees_as_engaged(accounts: DataFrame, country: str) -> DataFrame:
    """Employees and their hours := persons engaged and theirs."""
    return accounts.withColumns(replaced(country, {"empe": F.col("emp"), "hours_empe": F.col("hours_emp")}))


def hours_per_worker(accounts: DataFrame, country: str, hours: DataFrame) -> DataFrame:
    """Hours = persons x coefficient x 1000 by (year, sector); employees := engaged."""
    rows = accounts.join(hours.select("year", "sector", "coefficient"), ["year", "sector"], "left")
    rows = rows.withColumns(replaced(country, {"hours_emp": F.col("emp") * F.col("coefficient") * 1000}))
    return rows.withColumns(replaced(country, {"empe": F.col("emp"), "hours_empe": F.col("hours_emp")})).select(*accounts.columns)


def wage_share(accounts: DataFrame, country: str, shares: DataFrame) -> DataFrame:
    """Employees and hours := engaged x the year's share of wage workers in per cent."""
    rows = accounts.join(shares.select("year", "percent"), "year", "left")
    return rows.withColumns(replaced(country, {"empe": F.col("emp") * F.col("percent") / 100, "hours_empe": F.col("hours_emp") * F.col("percent") / 100})).select(*accounts.columns)


def wage_shares(accounts: DataFrame, shares: DataFrame) -> DataFrame:
    """The same for every country and year in ``shares`` (country, year, percent)."""
    rows = accounts.join(shares.select("country", "year", "percent"), ["country", "year"], "left")
    own = lambda total, old: F.when(F.col("percent").isNotNull(), F.col(total) * F.col("percent") / 100).otherwise(F.col(old))
    return rows.withColumns({"empe": own("emp", "empe"), "hours_empe": own("hours_emp", "hours_empe")}).select(*accounts.columns)


def least_intensive(accounts: DataFrame, exclude_row: bool = True, basis: str = "hours_emp", row: str = ROW) -> DataFrame:
    """(year, least, per_basis): the country of least capital per hour (or worker) and that ratio; a country
    without either counts as infinite, ties go to the first label."""
    rows = accounts.where(F.col("country") != row) if exclude_row else accounts
    by = rows.groupBy("year", "country").agg(F.sum("capital").alias("k"), F.sum(basis).alias("h"))
    ratio = F.when((F.col("h") == 0) | (F.col("k") == 0), F.lit(float("inf"))).otherwise(F.col("k") / F.col("h"))
    least = by.groupBy("year").agg(F.min(F.struct(ratio.alias("ratio"), "country")).alias("m"))
    return least.select("year", F.col("m.country").alias("least"), F.col("m.ratio").alias("per_basis"))


def rest_of_world(accounts: DataFrame, jobs: DataFrame, row: str = ROW, exclude_row: bool = True, basis: str = "hours_emp") -> DataFrame:
    """Fills one region's persons, hours and capital.

    Persons: the year's total (``jobs``: year, total) spread by value added times the other
    countries' persons per value added; hours by their hours per person; capital by the sector's
    capital per ``basis`` (hours, or persons in the older way) in the least capital-intensive country
    (its aggregate where the sector has none there).
    """
    others = accounts.where(F.col("country") != row)
    world = others.groupBy("year", "sector").agg(F.sum("emp").alias("e"), F.sum("hours_emp").alias("h"), F.sum("gdp_us").alias("va"))
    own = accounts.where(F.col("country") == row).join(world, ["year", "sector"])
    need = F.col("gdp_us") * F.try_divide("e", "va")
    part = F.try_divide(need, F.sum(need).over(W.partitionBy("year")))
    own = own.join(jobs, "year").withColumn("emp", F.col("total") * part).withColumn("hours_emp", F.col("emp") * divide("h", "e", "zero_if_denominator_zero"))
    least = least_intensive(accounts, exclude_row, basis, row)
    k = accounts.join(least, ["year"]).where("country = least").select("year", "sector", F.col("capital").alias("lk"), F.col(basis).alias("lb"), "per_basis")
    own = own.join(k, ["year", "sector"], "left").withColumn("capital", F.when(F.col("lb") != 0, F.col(basis) * F.col("lk") / F.col("lb")).when(F.col(basis) == 0, 0.0).otherwise(F.col(basis) * F.col("per_basis")))
    return others.unionByName(own.select(*accounts.columns))


def skill_shares_from_mean(accounts: DataFrame, row: str = ROW) -> DataFrame:
    """The region's skill shares := means over countries by (year, sector); the third is the rest."""
    mean = accounts.where(F.col("country") != row).groupBy("year", "sector").agg(F.avg("share_hs").alias("m_hs"), F.avg("share_ms").alias("m_ms"))
    rows = accounts.join(mean, ["year", "sector"], "left").withColumns(replaced(row, {"share_hs": F.col("m_hs"), "share_ms": F.col("m_ms")}))
    return rows.select(*accounts.columns, (1 - F.col("share_hs") - F.col("share_ms")).alias("share_ls"))


def compensation_from_world(accounts: DataFrame, row: str = ROW) -> DataFrame:
    """The region's compensation := value added x the other countries' compensation per value added."""
    ratio = accounts.where(F.col("country") != row).groupBy("year", "sector").agg(F.try_divide(F.sum("comp_emp"), F.sum("gdp_us")).alias("r"))
    return accounts.join(ratio, ["year", "sector"], "left").withColumns(replaced(row, {"comp_emp": F.col("gdp_us") * F.col("r")})).select(*accounts.columns)


def compensation_spread(accounts: DataFrame, columns: tuple[str, ...] = ("comp_emp", "comp_empe"), row: str = ROW) -> DataFrame:
    """The region's compensation := its value added x the other countries' compensation per value added,
    spread over sectors by value added x their compensation per person."""
    others = F.col("country") != row
    year, cell = W.partitionBy("year"), W.partitionBy("year", "sector")
    out = {}
    for c in columns:
        total = F.try_divide(F.sum(F.when(others, F.col(c))).over(year), F.sum(F.when(others, F.col("gdp_us"))).over(year)) * F.sum(F.when(~others, F.col("gdp_us"))).over(year)
        out[f"{c}_total"] = total
        out[f"{c}_key"] = F.when(~others, F.col("gdp_us") * F.try_divide(F.sum(F.when(others, F.col(c))).over(cell), F.sum(F.when(others, F.col("emp"))).over(cell)))
    rows = accounts.withColumns(out)
    rows = rows.withColumns({f"{c}_part": F.try_divide(F.col(f"{c}_key"), F.sum(f"{c}_key").over(year)) for c in columns})
    return rows.withColumns(replaced(row, {c: F.col(f"{c}_total") * F.col(f"{c}_part") for c in columns})).select(*accounts.columns)


def capital_from_list(accounts: DataFrame, countries: list[str], row: str = ROW) -> DataFrame:
    """The region's capital := value added x capital per value added of a fixed list of countries."""
    ratio = accounts.where(F.col("country").isin(countries)).groupBy("year", "sector").agg(F.try_divide(F.sum("capital"), F.sum("gdp_us")).alias("r"))
    return accounts.join(ratio, ["year", "sector"], "left").withColumns(replaced(row, {"capital": F.col("gdp_us") * F.col("r")})).select(*accounts.columns)


def constant_capital(accounts: DataFrame, base_year: int, row: str = ROW) -> DataFrame:
    """capital_cu of the region = capital x rate index / price index; the base year must agree with
    current prices and zeros stay zeros."""
    c = divide(F.col("capital") * F.col("exchange_id"), F.col("go_price"), "error")
    wrong = (F.col("year") == base_year) & (F.abs(c - F.col("capital")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("capital"))) | ((F.col("capital") == 0) & (c != 0))
    new = F.when(wrong, F.raise_error(F.lit("constant capital breaks its identity")).cast("double")).otherwise(c)
    return accounts.withColumn("capital_cu", F.when(F.col("country") == row, new))


def without_region(accounts: DataFrame, columns: list[str], row: str = ROW) -> DataFrame:
    """The region's indicators := 0."""
    return accounts.withColumns(replaced(row, {c: F.lit(0.0) for c in columns}))


def converted(flows: DataFrame, accounts: DataFrame, rates: DataFrame, money: list[str]) -> tuple[DataFrame, DataFrame]:
    """Flows and money columns times the year's rate; the rate itself is kept."""
    r = rates.select("year", "rate")
    return flows.join(r, "year").withColumn("value", F.col("value") * F.col("rate")).drop("rate"), accounts.join(r, "year").withColumns({m: F.col(m) * F.col("rate") for m in money}).drop("rate")
