"""Lines are summed as whole hundredths, with the results of decimals on odd lines too."""

import re
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

from flowmill.sources import market

#: (price, discount, tax, quantity, status)
LINES = [
    (901.07, 0.03, 0.02, 7.0, "O"), (901.07, 0.029, 0.02, 7.0, "F"), (1.005, 0.07, 0.045, 0.995, "O"), (-12.345, 0.0299999, -0.08, 3.0, "O"), (0.004999999999999999, 0.1, 0.0, 50.0, None),
    (None, 0.01, 0.02, 4.0, "O"), (55.55, None, 0.02, 4.0, "O"), (55.55, 0.05, None, None, "F"), (1e9 + 0.015, 0.05, 0.02, 1.0, "F"), (8e13, 0.02, 0.08, 1e12, "O"), (8e13, 0.02, 0.08, 1e12, "O"), (8e13, 0.02, None, 1e12, None),
    (-7e13, None, 5.0, 2.0, "O"), (20.0, 1e12, 1e11, 1.0, "O"), (42949672.95, 0.0, 0.0, 42949672.97, "F"), (123456789012345.67, 0.06, 0.01, 9.0, "F"),
]


def tables(spark, folder):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")

    put("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("supplier", [(1, 0)], "s_suppkey long, s_nationkey int")
    put("customer", [(1, 0, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string")
    put("part", [(1, 5)], "p_partkey long, p_size int")
    put("orders", [(1, 1)], "o_orderkey long, o_custkey long")
    rows = [(1, 1, 1, q, p, d, t, None, s, datetime(1996, 5, 5)) for p, d, t, q, s in LINES]
    put("lineitem", rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    return str(folder)


def wanted():
    two = lambda v: None if v is None else Decimal(repr(v)).quantize(Decimal("0.01"), ROUND_HALF_UP)
    rows = [(*map(two, r[:4]), r[4] == "O") for r in LINES]
    total = lambda f: sum((x for x in (f(*r) for r in rows) if x is not None), Decimal(0))
    pay = lambda p, t: None if p is None or t is None else p * t * 8
    high, middle = lambda d: d is not None and d < Decimal("0.03"), lambda d: d is not None and Decimal("0.03") <= d < Decimal("0.07")
    return {
        "emp": len(rows), "empe": sum(r[4] for r in rows), "go_us": total(lambda p, d, t, q, o: p), "gdp_us": total(lambda p, d, t, q, o: None if p is None or d is None else p * (1 - d)),
        "hours_emp": total(lambda p, d, t, q, o: q), "hours_empe": total(lambda p, d, t, q, o: q if o else None), "comp_emp": total(lambda p, d, t, q, o: pay(p, t)), "comp_empe": total(lambda p, d, t, q, o: pay(p, t) if o else None),
        "capital": total(lambda p, d, t, q, o: None if p is None or d is None else p * d * 20), "hours_hs": total(lambda p, d, t, q, o: q if high(d) else None), "hours_ms": total(lambda p, d, t, q, o: q if middle(d) else None),
        "comp_hs": total(lambda p, d, t, q, o: pay(p, t) if high(d) else None), "comp_ms": total(lambda p, d, t, q, o: pay(p, t) if middle(d) else None),
    }


def test_odd_lines_are_summed_exactly(spark, tmp_path):
    (row,) = market.cells(spark, tables(spark, tmp_path)).collect()
    assert {n: row[n] for n in wanted()} == wanted()


def test_no_decimal_is_summed_by_line(spark, tmp_path):
    """Decimals of more than 18 digits took most of the time of the pass over the facts."""
    plan = market.cells(spark, tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    by_line = [line for line in plan.splitlines() if re.match(r"\W*Aggregate ", line)][-1]
    assert "sum(price" in by_line and "decimal" not in by_line and "MakeDecimal" not in by_line


def test_few_sellers_shuffle_no_lines(spark, tmp_path, monkeypatch):
    """At 6 GB Spark's estimate of the sellers had all lines shuffled by seller too, and every shuffle carried wide lines."""
    folder = tables(spark, tmp_path)
    plan = lambda: market.cells(spark, folder)._jdf.queryExecution().executedPlan().toString()
    by_seller = lambda text: [line for line in text.splitlines() if re.search(r"Join \[l_suppkey", line)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (join,) = by_seller(plan())
        assert "BroadcastHashJoin" in join
        shuffled = market.lines(spark, folder)
        monkeypatch.setattr(market, "BROADCAST_ROWS", 0)
        (many,) = by_seller(plan())
        (row,) = market.cells(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in many
    assert {n: row[n] for n in wanted()} == wanted()
    assert {n for n, t in shuffled.dtypes if t not in ("int", "bigint", "boolean")} == {"o_country", "d_country"}
