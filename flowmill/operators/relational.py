"""Keyed-table idioms: precedence merges, look-ups, series, ranks, sets and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.functions.keep import kept


def precedence(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first layer that has a key; within a layer the first position wins."""
    all_ = reduce(DataFrame.unionByName, [d.withColumn("layer", F.lit(i)) for i, d in enumerate(layers)])
    w = W.partitionBy(key).orderBy("layer", "pos")
    return all_.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def execution_order(rows: DataFrame, name: str = "place") -> DataFrame:
    """Adds the place by stage, then order (missing last), then position."""
    return placed(rows, ["stage", "order"], ["pos"], name)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    import re

    return [c for c in df.columns if re.search(pattern, c)]


def row_sum(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Sum of all columns whose name matches."""
    return df.withColumn(name, reduce(Column.__add__, [F.col(c) for c in columns_like(df, pattern)]))


def skeleton(*labels: DataFrame) -> DataFrame:
    """Cross product of label tables (dimensions, never facts)."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), labels)


def typed_lookup(rows: DataFrame, wide: DataFrame, keys: list[str], types: list[str], by: str, name: str) -> DataFrame:
    """For each row the column of ``wide`` that the row's type names: unpivot, then equi-join."""
    long = wide.unpivot(keys, types, by, name)
    return rows.join(long, [*keys, by], "left")


def with_fallback(rows: DataFrame, table: DataFrame, key: str, fallback: str, on: list[str]) -> DataFrame:
    """Rows joined to a table, keys that it lacks to its fallback key."""
    known = table.select(F.col(key).alias("known")).distinct()
    keyed = rows.join(known, F.col(key) == F.col("known"), "left").withColumn("used", F.coalesce("known", F.lit(fallback))).drop("known")
    return keyed.join(table.withColumnRenamed(key, "used"), ["used", *on], "left")


def shifted(rows: DataFrame, table: DataFrame, keys: list[str], offset: int) -> DataFrame:
    """Joins each year to the table's year + offset."""
    return rows.join(table.withColumn("year", F.col("year") - offset), ["year", *keys], "left")


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has; empty if the key sets are in bijection."""
    return a.select(*keys, F.lit(1).alias("x")).join(b.select(*keys, F.lit(1).alias("y")), keys, "full").where("x is null or y is null").select(*keys, F.when(F.col("x").isNull(), "right").otherwise("left").alias("only"))


def not_exactly_one(df: DataFrame, key: str, condition: Column, labels: DataFrame) -> DataFrame:
    """Labels that don't have exactly one row satisfying the condition."""
    n = df.where(condition).groupBy(key).agg(F.count("*").alias("n"))
    return labels.join(n, key, "left").where("coalesce(n, 0) <> 1").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def iso2(iso3: Column, table: dict[str, str]) -> Column:
    """Two-letter codes by a label table, with the exceptions GBR, GRC and ROW."""
    own = {**table, "GBR": "UK", "GRC": "EL", "ROW": "NA"}
    return F.element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), iso3)


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Order-safe dedup."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("rn = 1").drop("rn")


def poisoned_sum(value: str) -> Column:
    """Sum that is NULL if any cell of the group is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def weighted_mean(value: str, weight: str) -> Column:
    """Missing values are left out with their weights; a missing weight poisons the group."""
    lost = F.max(F.when(F.col(value).isNotNull() & F.col(weight).isNull(), 1).otherwise(0)) == 1
    return F.when(lost, F.lit(None).cast("double")).otherwise(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))))


def share_of_total(value: str, label: str, total: str, keys: list[str]) -> Column:
    """A cell over the row with the total's label in its partition."""
    return F.try_divide(F.col(value), F.max(F.when(F.col(label) == total, F.col(value))).over(W.partitionBy(*keys)))


def absolute_rank(df: DataFrame, value: str, ties: list[str], keys: list[str], name: str = "rank") -> DataFrame:
    """Adds the rank by size within ``keys``, ties by label order; a missing value ranks last. Ranks are
    places in one sorted table less the place where a group begins, so a group may be of any size."""
    order = [*(F.asc_nulls_first(k) for k in keys), F.abs(value).desc_nulls_last(), *(F.asc_nulls_first(t) for t in ties)]
    rows = in_places(df, order, name)
    begins = rows.groupBy(*(F.col(k).alias(f"{k}_") for k in keys)).agg(F.min(name).alias("begins_"))
    return rows.join(begins, same(keys)).withColumn(name, F.col(name) - F.col("begins_") + 1).select(*df.columns, name)


def cumulative_index(df: DataFrame, percent: str, keys: list[str], base_year: int, name: str = "index") -> DataFrame:
    """Level of chained yearly changes in per cent, 100 in the base year. Changes over -100 %."""
    w = W.partitionBy(*keys).orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    level = F.exp(F.sum(F.log1p(F.col(percent) / 100)).over(w))
    out = df.withColumn(name, level)
    return out.withColumn(name, 100 * F.col(name) / F.max(F.when(F.col("year") == base_year, F.col(name))).over(W.partitionBy(*keys)))


def carried_forward(value: str, keys: list[str]) -> Column:
    """The last known value of the series."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy("year").rowsBetween(W.unboundedPreceding, 0))


def latest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n of each key."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("rn") <= n).drop("rn")


def worst(df: DataFrame, scaled: str, keys: list[str], group: list[str]) -> DataFrame:
    """The cell with the largest scaled error of each group; ties by label order."""
    top = F.max(F.struct(F.col(scaled).alias("s"))).getField("s")
    best = df.groupBy(*group).agg(top.alias("top"))
    return df.join(best, group).where(F.col(scaled) == F.col("top")).groupBy(*group).agg(F.min(F.struct(*keys)).alias("cell"), F.max("top").alias(scaled)).select(*group, *(F.col(f"cell.{k}").alias(k) for k in keys if k not in group), scaled)


def missing_and_unexpected(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Set differences of labels, both ways."""
    a = expected.select(key).distinct().join(actual.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("missing"))
    b = actual.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return a.unionByName(b)


def set_fingerprint(df: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """MD5 of the sorted distinct labels joined by newlines, per key. For label sets, not facts."""
    return df.groupBy(*keys).agg(F.md5(F.array_join(F.sort_array(F.collect_set(label)), "\n")).alias("md5"))


def stacked_labels(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, kind) of several label tables, without repeats."""
    return reduce(DataFrame.unionByName, [d.select(F.col(d.columns[0]).cast("string").alias("name"), F.lit(k).alias("kind")) for k, d in tables.items()]).dropDuplicates()


def same(keys: list[str]) -> Column:
    """Join condition: equal keys, missing ones equal to each other, against columns with a trailing underscore."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])


#: A row's identifier is its partition's number and, in this many bits, its place there.
ROW_BITS = 33


def in_places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds ``name``, the row's number from 1 in the order given, which should leave no ties.

    Rows are range-partitioned and sorted once and written with their place in the partition; sizes
    of partitions, a row each, give what stands before. No window or task sees more than a range,
    however few the leading keys are.
    """
    rows = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_", F.monotonically_increasing_id()), "places")
    part = F.shiftright("row_", ROW_BITS)
    sizes = rows.groupBy(part.alias("part_")).agg(F.count("*").alias("size_"))
    before = F.coalesce(F.sum("size_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part_", before.alias("before_"))  # a row for each partition, so it can be broadcast
    place = F.col("row_").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + F.col("before_") + 1
    return rows.join(F.broadcast(starts), part == F.col("part_")).select(*df.columns, place.alias(name))


def placed(df: DataFrame, groups: list[str], within: list[str], name: str = "place") -> DataFrame:
    """``name``: the row's number in the order of ``groups`` (nulls last) and ``within``."""
    return in_places(df, [*map(F.asc_nulls_last, groups), *map(F.asc_nulls_first, within)], name)


def exact_quantile(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, ``name``, least, most): the exact quantile of each group, linear between neighbours, as double.

    Missing values are left out; a group without others has missing results. The values that a
    quantile lies between are looked up by their places in one sorted table, at most two a group.
    """
    rows = in_places(df.select(*keys, F.col(value).cast("double").alias("value_")), [*map(F.asc_nulls_first, keys), F.asc_nulls_last("value_")], "place_")
    groups = rows.groupBy(*keys).agg(F.min("place_").alias("begins_"), F.count("value_").alias("n_"), F.min("value_").alias("least"), F.max("value_").alias("most"))
    at = (F.col("n_") - 1) * F.lit(float(share))
    groups = kept(groups.withColumns({"low_": F.col("begins_") + F.floor(at), "high_": F.col("begins_") + F.ceil(at), "between_": at - F.floor(at)}), "quantiles")
    asked = groups.where("n_ > 0").select("begins_", F.explode(F.array_distinct(F.array("low_", "high_"))).alias("place_"))
    pair = rows.select("place_", "value_").join(asked, "place_").groupBy("begins_").agg(F.min("value_").alias("from_"), F.max("value_").alias("to_"))
    step = F.when(F.col("from_") == F.col("to_"), F.col("from_")).otherwise(F.col("from_") + F.col("between_") * (F.col("to_") - F.col("from_")))
    return groups.join(pair, "begins_", "left").select(*keys, step.alias(name), "least", "most")


def side_by_side(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two results; columns that both have get the suffixes _x and _y."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    named = lambda df, end: df.select(*keys, *(F.col(c).alias(f"{c}{end}" if c in shared else c) for c in df.columns if c not in keys))
    return named(a, "_x").join(named(b, "_y"), keys, "left")


def first_examples(rows: DataFrame, groups: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The first n rows of each group, for error reports."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rn") <= n).drop("rn")
