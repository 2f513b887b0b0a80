"""Refusals and edge cases of the operators on sources, lists and audits."""

import pytest
from pyspark.sql import functions as F

from flowmill.functions.aggspec import AggSpec, audited
from flowmill.operators import capital, relational, validation
from flowmill.sources import readers

STOCK = "year int, country string, sector string, stock double"
CELLS = "year int, o_country string, o_sector string, d_country string, d_sector string, weight double"


def test_artifacts_against_manifest(spark, tmp_path):
    for name in ("a.parquet", "b.parquet", "c.txt"):
        (tmp_path / name).write_text("x")
    got = readers.artifact_errors(spark, str(tmp_path), ["*.parquet"], ["a.parquet", "d.parquet"])
    assert {tuple(r) for r in got.collect()} == {("b.parquet", "not in manifest"), ("d.parquet", "missing")}


def test_stock_lists(spark):
    stock = spark.createDataFrame([(2000, "A", "S", -1.0), (2000, "B", "S", 2.0), (2000, "ROW", "S", None)], STOCK)
    pinned = stock.where("stock < 0")
    got = {r.country: r.stock for r in capital.sanitised_stock(stock, pinned, "ROW").collect()}
    assert got == {"A": 0.0, "B": 2.0, "ROW": None}
    with pytest.raises(ValueError, match="pinned"):
        capital.sanitised_stock(stock, pinned.withColumn("stock", F.lit(-2.0)), "ROW")
    with pytest.raises(Exception, match="missing capital stock"):
        capital.sanitised_stock(stock, pinned, "B").collect()


def test_truncation_keeps_missing_cells(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, 3.0)], "k int, v double")
    kept, ledger = capital.truncated(df, "v")
    assert [r.v for r in kept.orderBy("k").collect()] == [0.0, None, 3.0]
    assert [r.k for r in ledger.collect()] == [1]


def test_strict_allocation_takes_the_allowed_fallbacks_alone(spark):
    w = spark.createDataFrame([(2000, "A", "S", "A", "S", 1.0), (2000, "B", "S", "A", "S", 3.0)], CELLS)
    stock = spark.createDataFrame([(2000, "A", "S", 8.0), (2000, "B", "S", 4.0)], STOCK)
    fallback = spark.createDataFrame([(2000, "A", "S", "B", 1.0)], "year int, o_country string, o_sector string, d_country string, weight double")
    allowed = spark.createDataFrame([(2000, "B", "S")], "year int, d_country string, d_sector string")
    got = {(r.o_country, r.d_country): r.value for r in capital.strict_allocation(w, stock, fallback, allowed).collect()}
    assert got == {("A", "A"): 2.0, ("B", "A"): 6.0, ("A", "B"): 4.0}
    with pytest.raises(ValueError, match="allowed"):
        capital.strict_allocation(w, stock, fallback, allowed.limit(0))
    with pytest.raises(ValueError, match="conserved"):
        capital.strict_allocation(w, stock, fallback.limit(0), allowed)
    with pytest.raises(Exception, match="negative weight"):
        capital.strict_allocation(w.withColumn("weight", F.when(F.col("o_country") == "A", -F.col("weight")).otherwise(F.col("weight"))), stock, fallback, allowed)


def test_audit_and_joins(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, v double")
    got = {r.k: (r.s, r.s__state, r.s__audit, r.m__audit) for r in audited(df, ["k"], {"s": AggSpec("sum", "v"), "m": AggSpec("mean", "v", missing="propagate")}).collect()}
    assert got == {"a": (1.0, "partial", "equal", "no value"), "b": (None, "missing", "no value", "no value")}
    both = relational.side_by_side(df, df.where("k = 'a' and v = 1").withColumn("z", F.lit(1)), ["k"])
    assert both.columns == ["k", "v_x", "v_y", "z"] and both.count() == 3
    assert relational.first_examples(df, ["k"], ["v"], 1).count() == 2


def test_round_trip_of_what_was_not_staged(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    more = df.unionByName(spark.createDataFrame([(3, 3.0)], "k int, v double"))
    assert tuple(validation.round_trip("r", df, None, ["k"], "v").first()) == ("r", 2, 2, 0, 0)
    assert tuple(validation.round_trip("r", df, more, ["k"], "v").first()) == ("r", 2, 0, 1, 0)


def test_result_csv_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a;b", None), ("c\"d", 0.5), (None, 1e20)], "t string, v double")
    readers.write_result_csv(df, str(tmp_path / "r"))
    back = spark.read.csv(str(tmp_path / "r"), sep=";", header=True, schema="t string, v double")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="differs"):
        readers.write_result_csv(df.unionByName(spark.createDataFrame([("", 1.0)], "t string, v double")), str(tmp_path / "s"))
