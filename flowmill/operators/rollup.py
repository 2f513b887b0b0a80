"""Sector to country to world roll-ups.

The world row ``WWW`` is rolled up from country values, never from sectors; formulas run afterwards
on both levels, from totals or from pairwise complete sector cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.aggspec import Binding, aggregate
from flowmill.functions.safe import divide

WORLD = "WWW"


def two_levels(sectors: DataFrame, registry: dict[str, Binding], formulas: dict[str, Callable[[], Column]] | None = None, states: bool = False) -> DataFrame:
    """(year, country or WWW, indicators). Two aggregations, because levels may differ in strategy."""
    countries = aggregate(sectors, ["year", "country"], {n: b.sector for n, b in registry.items()}, states)
    world = aggregate(countries, ["year"], {n: b.country for n, b in registry.items()}, states).withColumn("country", F.lit(WORLD))
    out = countries.unionByName(world, allowMissingColumns=True)
    for name, make in (formulas or {}).items():
        out = out.withColumn(name, make())
    return out


def ratio_of_pairs(sectors: DataFrame, top: str, bottom: str, name: str, where: Column | None = None, minus: float = 0.0, policy: str = "not_applicable") -> DataFrame:
    """A ratio of sums over cells where both are there, per country and for the world."""
    rows = sectors.where(F.col(top).isNotNull() & F.col(bottom).isNotNull())
    rows = rows.where(where) if where is not None else rows
    by = rows.groupBy("year", "country").agg(F.sum(top).alias("t"), F.sum(bottom).alias("b"))
    world = by.groupBy("year").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).withColumn("country", F.lit(WORLD))
    return by.unionByName(world).select("year", "country", (divide("t", "b", policy) - F.lit(minus)).alias(name))


def scoped_summary(cells: DataFrame, value: str = "value") -> DataFrame:
    """Counts, sum, removed mass and least value in total, by year, by investing and supplying
    country and by supplying sector, stacked with a scope label (one pass of grouping sets)."""
    g = cells.groupingSets([[], ["year"], ["d_country"], ["o_country"], ["o_sector"]], "year", "d_country", "o_country", "o_sector")
    out = g.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum(value).alias("sum"), F.sum(F.when(F.col(value) < 0, -F.col(value)).otherwise(F.lit(0.0))).alias("removed"), F.min(value).alias("least"))
    scope = F.when(F.col("g") == 15, "total").when(F.col("g") == 7, "year").when(F.col("g") == 11, "investing_country").when(F.col("g") == 13, "supplying_country").otherwise("supplying_sector")
    label = F.coalesce(F.col("year").cast("string"), "d_country", "o_country", "o_sector", F.lit("all"))
    return out.select(scope.alias("scope"), label.alias("label"), "n", "sum", "removed", "least")
