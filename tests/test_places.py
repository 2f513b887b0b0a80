"""Places, ranks and quantiles against plain Python, with groups that fill several ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.operators import analytics, relational

ROWS = [(random.Random(k).choice("aaaaab") if k % 50 else None, random.Random(k + 1).randrange(40) - 20.0 if k % 7 else None, k) for k in range(600)]


@pytest.fixture
def wide(spark):
    """Few groups over many partitions."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark):
    return spark.createDataFrame(ROWS, "k string, v double, n int").repartition(5)


def test_places_run_through_all_ranges(wide):
    got = relational.in_places(table(wide), [F.asc_nulls_last("k"), F.desc_nulls_last("n")])
    want = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or "", -r[2]))
    assert [r[:3] for r in sorted(map(tuple, got.collect()), key=lambda r: r[3])] == want
    assert sorted(r.place for r in got.collect()) == list(range(1, len(ROWS) + 1))


def test_ranks_within_a_hot_group(wide):
    got = {r.n: r.rank for r in relational.absolute_rank(table(wide), "v", ["n"], ["k"]).collect()}
    for k in {r[0] for r in ROWS}:
        group = sorted((r for r in ROWS if r[0] == k), key=lambda r: (r[1] is None, -abs(r[1] or 0), r[2]))
        assert [got[r[2]] for r in group] == list(range(1, len(group) + 1))


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_quantiles_are_exact(wide, share):
    rows = table(wide).unionByName(wide.createDataFrame([("none", None, 1), ("one", 4.5, 1)], "k string, v double, n int"))
    got = {r.k: (r.q, r.least, r.most) for r in relational.exact_quantile(rows, ["k"], "v", share, "q").collect()}
    for k in {r[0] for r in ROWS}:
        values = [r[1] for r in ROWS if r[0] == k and r[1] is not None]
        assert got[k] == (pytest.approx(float(np.quantile(values, share)), abs=1e-12), min(values), max(values))
    assert got["none"] == (None, None, None) and got["one"] == (4.5, 4.5, 4.5)


def test_empty_tables(wide):
    none = table(wide).limit(0)
    assert relational.in_places(none, [F.asc("n")]).count() == 0
    assert relational.absolute_rank(none, "v", ["n"], ["k"]).count() == 0
    assert analytics.timing_summary(none.select(F.col("k").alias("strategy"), F.col("v").alias("seconds"))).count() == 0
