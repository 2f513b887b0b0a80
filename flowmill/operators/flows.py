"""Masks, keys and reductions of flows.

Flows are io_flow(year, o_country, o_sector, d_country, d_sector, kind, value). Masks are
predicates and keys, never matrices. Reductions over one key family share a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGIN = ["year", "o_country", "o_sector"]
PAIR = ["year", "o_country", "d_country"]
IMPORT = ["year", "d_country", "o_sector"]


def trade() -> Column:
    """Between two countries; final demand included."""
    return F.col("o_country") != F.col("d_country")


def only_productive(flows: DataFrame, sectors: DataFrame) -> DataFrame:
    """Flows whose origin sector is productive. ``sectors``: (sector, productive), a label table."""
    return flows.join(sectors.where("productive = 1").select(F.col("sector").alias("o_sector")), "o_sector", "left_semi").select(*flows.columns)


def with_lambda(flows: DataFrame, lam: DataFrame) -> DataFrame:
    """Adds ``worth`` = value x lambda of the origin. ``lam``: (year, country, sector, lam)."""
    side = lam.select("year", F.col("country").alias("o_country"), F.col("sector").alias("o_sector"), "lam")
    return flows.join(side, ORIGIN, "left").withColumn("worth", F.col("value") * F.coalesce("lam", F.lit(0.0))).drop("lam")


def by_destination(valued: DataFrame) -> DataFrame:
    """Value and worth by origin industry and destination country, whose number does not grow with the
    flows' cells: balance factors, gross output, exports, imports and bilateral tables are sums of it."""
    return valued.groupBy(*ORIGIN, "d_country").agg(F.sum("value").alias("value"), F.sum("worth").alias("worth"))


def balance_factor(valued: DataFrame, productive: Column) -> DataFrame:
    """(year, bf): value of all trade over prices of trade of productive origin."""
    bottom = F.sum(F.when(trade() & productive, F.col("value")))
    return valued.groupBy("year").agg(F.sum(F.when(trade(), F.col("worth"))).alias("top"), bottom.alias("bottom")).select("year", F.try_divide("top", "bottom").alias("bf"))


def with_transfers(valued: DataFrame, bf: DataFrame) -> DataFrame:
    """Adds ``transfer`` = price x balance factor - value between countries, 0 within one."""
    return valued.join(bf, "year").withColumn("transfer", F.when(trade(), F.col("value") * F.col("bf") - F.col("worth")).otherwise(F.lit(0.0)))


def bilateral(flows: DataFrame, columns: dict[str, Column], countries: DataFrame | None = None) -> DataFrame:
    """Sums by (year, origin, destination) with an exact 0 on the diagonal. ``countries`` completes
    the grid of label pairs, so that absent pairs are 0."""
    sums = flows.groupBy(*PAIR).agg(*(F.sum(F.when(trade(), c).otherwise(F.lit(0.0))).alias(n) for n, c in columns.items()))
    if countries is not None:
        grid = flows.select("year").distinct().crossJoin(F.broadcast(countries.select(F.col("country").alias("o_country")))).crossJoin(F.broadcast(countries.select(F.col("country").alias("d_country"))))
        sums = grid.join(sums, PAIR, "left").fillna(0.0, list(columns))
    return sums.withColumnsRenamed({"o_country": "origin", "d_country": "destination"})


def reduced(transferred: DataFrame, productive: Column, countries: DataFrame | None = None) -> DataFrame:
    """The seven bilateral tables in one aggregation: exports in values, prices and productive
    prices, transfers in values (all and productive) and both over the balance factor."""
    p = lambda c: F.when(productive, F.col(c)).otherwise(F.lit(0.0))
    out = bilateral(transferred, {
        "exports_values": F.col("worth"), "exports_mp": F.col("value"), "exports_productive_mp": p("value"), "transfers_values": F.col("transfer"), "transfers_productive_values": p("transfer"),
    }, countries)
    bf = transferred.select("year", "bf").distinct()
    out = out.join(bf, "year")
    return out.withColumn("transfers_dp", F.try_divide("transfers_values", "bf")).withColumn("transfers_productive_dp", F.try_divide("transfers_productive_values", "bf")).drop("bf")


def exports(flows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Row sums over trade by origin industry."""
    sums = flows.groupBy(*ORIGIN).agg(*(F.sum(F.when(trade(), c).otherwise(F.lit(0.0))).alias(n) for n, c in columns.items()))
    return sums.withColumnsRenamed({"o_country": "country", "o_sector": "sector"})


def imports(flows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Sums over trade by destination country and origin sector."""
    sums = flows.groupBy(*IMPORT).agg(*(F.sum(F.when(trade(), c).otherwise(F.lit(0.0))).alias(n) for n, c in columns.items()))
    return sums.withColumnsRenamed({"d_country": "country", "o_sector": "sector"})


def by_industry(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """Joins industry tables to the full label domain; absent sums are 0, not missing."""
    keys = ["year", "country", "sector"]
    for part in parts:
        new = [c for c in part.columns if c not in keys]
        base = base.join(part, keys, "left").fillna(0.0, new)
    return base


def net_transfer_share(pairs: DataFrame, gdp: DataFrame, value: str = "transfers_values") -> DataFrame:
    """(year, country, share): (sent - received) over gdp in labour values."""
    sent = pairs.groupBy("year", F.col("origin").alias("country")).agg(F.sum(value).alias("sent"))
    got = pairs.groupBy("year", F.col("destination").alias("country")).agg(F.sum(value).alias("got"))
    out = sent.join(got, ["year", "country"], "full").join(gdp, ["year", "country"], "left")
    return out.select("year", "country", F.try_divide(F.coalesce("sent", F.lit(0.0)) - F.coalesce("got", F.lit(0.0)), "gdp_mv").alias("share"))


def split_label(label: Column) -> tuple[Column, Column]:
    """country and sector of ``country.sector``; sectors may hold dots themselves."""
    return F.regexp_extract(label, r"^([^.]+)\.(.*)$", 1), F.regexp_extract(label, r"^([^.]+)\.(.*)$", 2)


def joined_label(country: str, sector: str) -> Column:
    return F.concat_ws(".", country, sector)
