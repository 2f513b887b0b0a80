"""Consumption baskets, column allocation of capital, depreciation and price indices.

Allocations are shares within a destination's column: one window over the destination key. Rows
without weight are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMN = ["year", "d_country", "d_sector"]


def share(value: str | Column, keys: list[str]) -> Column:
    """value / sum over the partition; NULL where the sum is 0."""
    v = F.col(value) if isinstance(value, str) else value
    return F.try_divide(v, F.sum(v).over(W.partitionBy(*keys)))


def national_basket(flows: DataFrame, demand: str) -> DataFrame:
    """(year, o_country, o_sector, d_country, basket): each country's household column as shares;
    the same for all its sectors, so it is not replicated."""
    column = flows.where((F.col("kind") == "final") & (F.col("d_sector") == demand)).select("year", "o_country", "o_sector", "d_country", "value")
    return column.withColumn("basket", share("value", ["year", "d_country"])).drop("value")


def international_basket(flows: DataFrame, demand: str) -> DataFrame:
    """(year, o_country, o_sector, basket): household demand of all countries as shares."""
    column = flows.where((F.col("kind") == "final") & (F.col("d_sector") == demand)).groupBy("year", "o_country", "o_sector").agg(F.sum("value").alias("value"))
    return column.withColumn("basket", share("value", ["year"])).drop("value")


def labour_force_value(basket: DataFrame, lam: DataFrame, accounts: DataFrame, compensation: str) -> DataFrame:
    """(year, country, sector, lfv): value of the basket that a sector's compensation buys."""
    side = lam.select("year", F.col("country").alias("o_country"), F.col("sector").alias("o_sector"), "lam")
    keys = ["year", "d_country"] if "d_country" in basket.columns else ["year"]
    unit = basket.join(side, ["year", "o_country", "o_sector"]).groupBy(*keys).agg(F.sum(F.col("basket") * F.col("lam")).alias("unit"))
    unit = unit.withColumnRenamed("d_country", "country") if "d_country" in keys else unit
    return accounts.join(unit, ["year", "country"] if "d_country" in keys else ["year"], "left").select("year", "country", "sector", (F.col("unit") * F.col(compensation)).alias("lfv"))


def allocate(weights: DataFrame, stock: DataFrame, fallback: DataFrame | None = None, strict: bool = False, tolerance: float = 1e-10) -> DataFrame:
    """Spreads each destination's stock over its column in proportion to weights.

    ``weights``: (year, o_country, o_sector, d_country, d_sector, weight); ``stock``: (year, country,
    sector, stock). A column without weight and with stock takes the fallback's shares (keys as the
    weights', or without d_sector: by country). ``strict`` aborts on negative weights.
    """
    s = stock.select("year", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"), "stock")
    if strict:
        weights = weights.withColumn("weight", F.when(F.col("weight") < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(F.col("weight")))
    sums = weights.groupBy(*COLUMN).agg(F.sum("weight").alias("total"))
    main = weights.join(sums.where("total <> 0"), COLUMN).join(s, COLUMN).select("year", "o_country", "o_sector", "d_country", "d_sector", (F.col("weight") / F.col("total") * F.col("stock")).alias("value"))
    if fallback is None:
        return main
    keys = [k for k in COLUMN if k in fallback.columns]
    bare = s.join(sums.where("total <> 0"), COLUMN, "left_anti").where("stock <> 0")
    own = fallback.withColumn("part", share("weight", keys)).where("part is not null")
    rest = bare.join(own, keys).select("year", "o_country", "o_sector", "d_country", "d_sector", (F.col("part") * F.col("stock")).alias("value"))
    return main.unionByName(rest)


def conservation_errors(allocated: DataFrame, stock: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Destinations whose allocated sum differs from the stock by more than the relative tolerance."""
    got = allocated.groupBy(*COLUMN).agg(F.sum("value").alias("got"))
    s = stock.select("year", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"), "stock")
    both = s.join(got, COLUMN, "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
    return both.where(F.abs(F.col("got") - F.col("stock")) > tolerance * F.greatest(F.lit(1.0), F.abs("stock")))


def composition(shares: DataFrame, investment: DataFrame, ratio: DataFrame) -> DataFrame:
    """Weights of capital composition: value-added ratio of the destination x its share of the
    origin's capital type x investment of the origin in the destination country.

    ``shares``: (year, country, sector, ktype, share) of the destination, a country that lacks
    falls back to the mean country ``MD``; ``investment``: (year, o_country, o_sector, ktype,
    d_country, value); ``ratio``: (year, country, sector, ratio).
    """
    known = shares.select(F.col("country").alias("have")).distinct()
    dest = ratio.join(known, F.col("country") == F.col("have"), "left").withColumn("key", F.coalesce("have", F.lit("MD"))).drop("have")
    part = shares.select("year", F.col("country").alias("key"), "sector", "ktype", "share")
    d = dest.join(part, ["year", "key", "sector"]).select("year", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"), "ktype", (F.col("ratio") * F.col("share")).alias("factor"))
    return investment.join(d, ["year", "d_country", "ktype"]).select("year", "o_country", "o_sector", "d_country", "d_sector", "ktype", (F.col("value") * F.col("factor")).alias("weight"))


def depreciation(allocated: DataFrame, rates: DataFrame, ktypes: DataFrame, year_offset: int = 1) -> DataFrame:
    """k_depreciation = composition x rate of the destination sector and the origin's capital type,
    taken from year + offset. ``rates``: (year, sector, ktype, rate); ``ktypes``: (o_sector, ktype)."""
    r = rates.select((F.col("year") - year_offset).alias("year"), F.col("sector").alias("d_sector"), "ktype", "rate")
    typed = allocated.join(ktypes, "o_sector")
    return typed.join(r, ["year", "d_sector", "ktype"]).select("year", "o_country", "o_sector", "d_country", "d_sector", (F.col("value") * F.col("rate")).alias("value"))


def zero_depreciation(flows: DataFrame) -> DataFrame:
    """A depreciation table of zeros is an empty one: absent cells are 0."""
    return flows.select("year", "o_country", "o_sector", "d_country", "d_sector", F.lit(0.0).alias("value")).limit(0)


def truncated(df: DataFrame, value: str, allowed: DataFrame | None = None, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Negative cells set to 0 and a ledger of them. With ``allowed`` (an allow-list on ``keys``)
    the negative cells must be exactly those listed."""
    ledger = df.where(F.col(value) < 0)
    if allowed is not None:
        wrong = exact_set_errors(ledger, allowed, keys)
        if not wrong.isEmpty():
            raise ValueError(f"negative {value} outside the allow-list: {[r.asDict() for r in wrong.orderBy(*keys).limit(3).collect()]}")
    return df.withColumn(value, F.when(F.col(value) < 0, 0.0).otherwise(F.col(value))), ledger


def exact_set_errors(observed: DataFrame, expected: DataFrame, keys: list[str], value: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """Rows that are only observed or only expected, or whose values differ; empty if they match."""
    o = observed.select(*keys, *([F.col(value).alias("o_value")] if value else []), F.lit(True).alias("o"))
    e = expected.select(*keys, *([F.col(value).alias("e_value")] if value else []), F.lit(True).alias("e"))
    both = o.join(e, keys, "full").withColumn("problem", F.when(F.col("e").isNull(), "unexpected").when(F.col("o").isNull(), "missing"))
    if value:
        apart = F.abs(F.col("o_value") - F.col("e_value")) > tolerance * F.greatest(F.lit(1.0), F.abs("e_value"))
        both = both.withColumn("problem", F.coalesce("problem", F.when(apart, "different")))
    return both.where("problem is not null").select(*keys, "problem")


def value_added_ratio(top: Column, bottom: Column) -> Column:
    """0/0 is 0, anything else over 0 is NULL; a negative ratio counts by its size."""
    return F.when((top == 0) & (bottom == 0), F.lit(0.0)).otherwise(F.abs(F.try_divide(top, bottom)))


def rebased(df: DataFrame, value: str, keys: list[str], base_year: int) -> DataFrame:
    """``value`` over its value in the base year, by a window of the series."""
    base = F.max(F.when(F.col("year") == base_year, F.col(value))).over(W.partitionBy(*keys))
    return df.withColumn(value, F.try_divide(value, base))


def laspeyres(basket: DataFrame, prices: DataFrame, base_year: int) -> DataFrame:
    """(year, country, index): price of the base year's basket in each year, 1 in the base year.
    ``prices``: (year, country, sector, price) of the origin."""
    fixed = basket.where(F.col("year") == base_year).drop("year")
    p = prices.select("year", F.col("country").alias("o_country"), F.col("sector").alias("o_sector"), "price")
    level = p.join(fixed, ["o_country", "o_sector"]).groupBy("year", F.col("d_country").alias("country")).agg(F.sum(F.col("basket") * F.col("price")).alias("index"))
    return rebased(level, "index", ["country"], base_year)


def sanitised_stock(stock: DataFrame, pinned: DataFrame, row: str, tolerance: float = 1e-9) -> DataFrame:
    """Negative stocks, which must be exactly the pinned ones (year, country, sector, stock), become 0; a
    missing stock outside the rest of the world aborts, and one there stays missing."""
    keys = ["year", "country", "sector"]
    wrong = exact_set_errors(stock.where("stock < 0"), pinned, keys, "stock", tolerance)
    if not wrong.isEmpty():
        raise ValueError(f"negative stocks are not the pinned ones: {[r.asDict() for r in wrong.orderBy(*keys).limit(3).collect()]}")
    missing = F.raise_error(F.lit("missing capital stock")).cast("double")
    return stock.withColumn("stock", F.when(F.col("stock").isNull() & (F.col("country") != row), missing).when(F.col("stock") < 0, 0.0).otherwise(F.col("stock")))


def strict_allocation(weights: DataFrame, stock: DataFrame, fallback: DataFrame, allowed: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """``allocate`` that takes no negative weight, uses the fallback for exactly the ``allowed`` columns
    (year, d_country, d_sector), and gives back every stock within the relative tolerance."""
    s = stock.select("year", F.col("country").alias("d_country"), F.col("sector").alias("d_sector"), "stock")
    weighted = weights.groupBy(*COLUMN).agg(F.sum("weight").alias("total")).where("total <> 0")
    wrong = exact_set_errors(s.where("stock <> 0").join(weighted, COLUMN, "left_anti"), allowed, COLUMN)
    if not wrong.isEmpty():
        raise ValueError(f"columns without weight are not the allowed ones: {[r.asDict() for r in wrong.orderBy(*COLUMN).limit(3).collect()]}")
    out = allocate(weights, stock, fallback, strict=True)
    lost = conservation_errors(out, stock, tolerance)
    if not lost.isEmpty():
        raise ValueError(f"stock not conserved: {[r.asDict() for r in lost.limit(3).collect()]}")
    return out
