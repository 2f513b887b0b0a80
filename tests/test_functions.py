import pytest
from pyspark.sql import functions as F

from flowmill.functions import safe
from flowmill.functions.aggspec import AggSpec, Binding, aggregate, reconcile, resolve
from flowmill.functions.units import Unit, check_aggregation


def one(spark, rows, schema, spec):
    r = aggregate(spark.createDataFrame(rows, schema), [], {"v": spec}, states=True).first()
    return r.v, r.v__state


GOLDEN = [("weighted_mean", (0.9, 0.1), (10, 90), 0.18), ("weighted_mean", (0.8, 0.2), (25, 75), 0.35), ("weighted_mean", (0.8, 1.2), (10, 90), 1.16), ("weighted_mean", (1, 3), (90, 10), 1.2), ("ratio_of_sums", (8, 90), (2, 30), 3.0625), ("weighted_mean", (1, 3), (10, 30), 2.5), ("ratio_of_sums", (20, 120), (10, 30), 3.5), ("weighted_mean", (1, 9), (1, 3), 7), ("ratio_of_sums", (1, 90), (1, 10), 91 / 11)]


@pytest.mark.parametrize("strategy,a,b,want", GOLDEN)
def test_golden(spark, strategy, a, b, want):
    spec = AggSpec(strategy, "a", weight="b") if strategy == "weighted_mean" else AggSpec(strategy, numerator="a", denominator="b")
    assert one(spark, [(float(x), float(y)) for x, y in zip(a, b)], "a double, b double", spec)[0] == pytest.approx(want, rel=1e-12)


def test_sum_mean_and_missing(spark):
    rows = [(1.0,), (None,), (3.0,)]
    assert one(spark, [(1.0,), (9.0,)], "a double", AggSpec("mean", "a")) == (5.0, "finite")
    assert one(spark, rows, "a double", AggSpec("sum", "a")) == (4.0, "partial")
    assert one(spark, rows, "a double", AggSpec("sum", "a", missing="propagate")) == (None, "missing")
    assert one(spark, [(None,)], "a double", AggSpec("sum", "a")) == (None, "missing")
    with pytest.raises(Exception, match="missing cell"):
        one(spark, rows, "a double", AggSpec("sum", "a", missing="error"))


def test_zero_denominators(spark):
    rows, spec = [(1.0, 0.0)], lambda z: AggSpec("ratio_of_sums", numerator="a", denominator="b", zero=z)
    assert one(spark, rows, "a double, b double", spec("not_applicable")) == (None, "not_applicable")
    assert one(spark, rows, "a double, b double", spec("zero")) == (0.0, "zero_denominator")
    with pytest.raises(Exception, match="zero denominator"):
        one(spark, rows, "a double, b double", spec("error"))


def test_invariant_and_weights(spark):
    assert one(spark, [(3.0,), (3.0,)], "a double", AggSpec("invariant", "a"))[0] == 3.0
    with pytest.raises(Exception, match="not invariant"):
        one(spark, [(3.0,), (3.1,)], "a double", AggSpec("invariant", "a", tolerance=1e-12))
    with pytest.raises(Exception, match="negative weight"):
        one(spark, [(1.0, -1.0)], "a double, b double", AggSpec("weighted_mean", "a", weight="b"))
    with pytest.raises(Exception, match="NaN"):
        one(spark, [(float("nan"),)], "a double", AggSpec("sum", "a"))


def test_laws(spark):
    rows = [(float(v), float(w), float(v * w)) for v, w in ((3, 2), (5, 7), (11, 1))]
    wm, schema = AggSpec("weighted_mean", "v", weight="w"), "v double, w double, vw double"
    base = one(spark, rows, schema, wm)[0]
    assert base == pytest.approx(one(spark, [(v, 10 * w, x) for v, w, x in rows], schema, wm)[0], rel=1e-14)
    assert base == pytest.approx(one(spark, rows, schema, AggSpec("ratio_of_sums", numerator="vw", denominator="w"))[0], rel=1e-14)
    assert 3 <= base <= 11


def test_specs_are_checked():
    for bad in (dict(strategy="median", value="a"), dict(strategy="weighted_mean", value="a"), dict(strategy="sum", value="a", weight="b"), dict(strategy="formula")):
        with pytest.raises(ValueError):
            AggSpec(**bad)


def test_registry():
    rows = [{"indicator": "x", "level": v, "strategy": "sum"} for v in ("country", "world")]
    reg = resolve(rows)
    assert reg["x"] == Binding("x", AggSpec("sum", "x"), AggSpec("sum", "x"))
    assert reconcile(reg, reg) == [] and reconcile(reg, {}) == ["missing x"]
    with pytest.raises(ValueError):
        resolve(rows[:1])
    with pytest.raises(ValueError):
        resolve([{"indicator": "f", "level": "country", "strategy": "formula", "module": "m"}, {"indicator": "f", "level": "world", "strategy": "sum"}])


def test_division_policies(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (None, 1.0)], "n double, d double")
    got = {p: [r[0] for r in df.select(safe.divide("n", "d", p)).collect()] for p in safe.POLICIES if p != "error"}
    assert got == {"zero_if_both_zero": [0.5, 0.0, None], "not_applicable": [0.5, None, None], "not_applicable_if_both_zero": [0.5, None, None], "zero_if_denominator_zero": [0.5, 0.0, None]}
    with pytest.raises(Exception, match="division by zero"):
        spark.createDataFrame([(1.0, 0.0)], "n double, d double").select(safe.divide("n", "d", "zero_if_both_zero")).collect()
    v, s = safe.divide_states("n", "d", F.lit("finite"), F.lit("finite"), "not_applicable")
    assert [tuple(r) for r in df.select(v, s).collect()][:2] == [(0.5, "finite"), (None, "not_applicable")]


def test_states_round_trip(spark):
    df = spark.createDataFrame([(1, 2.0, None, "finite", "source_missing"), (2, None, 3.0, "uncomputed", "finite")], "k int, a double, b double, sa string, sb string")
    sparse = safe.sparse_states(df, ["k"], ["a", "b"], {"a": "sa", "b": "sb"})
    assert sorted(map(tuple, sparse.collect())) == [(1, "b", "source_missing"), (2, "a", "uncomputed")]
    back = safe.restored_states(df.select("k", "a", "b"), ["k"], ["a", "b"], sparse).orderBy("k").collect()
    assert [(r.a__state, r.b__state) for r in back] == [("finite", "source_missing"), ("uncomputed", "finite")]


def test_classification_aborts_on_special_values(spark):
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="NaN or infinite"):
            spark.createDataFrame([(bad,)], "a double").select(safe.classify("a", F.lit(True))).collect()
    with pytest.raises(Exception, match="outside the declared mask"):
        spark.createDataFrame([(None,)], "a double").select(safe.classify("a", F.lit(False))).collect()


def test_units():
    usd, hour, a, b = Unit.base("USD", price_basis="current"), Unit.base("hour"), Unit.base("LCU", scope="A"), Unit.base("LCU", scope="B")
    assert (usd / hour * hour).exponents == usd.exponents and (usd / usd).exponents == ()
    for bad in (lambda: usd + hour, lambda: a / b, lambda: usd * Unit.base("USD", price_basis="constant"), lambda: Unit.base("metre"), lambda: Unit.base("LCU"), lambda: usd.rebased("2000")):
        with pytest.raises(ValueError):
            bad()
    assert Unit.index("1995").rebased("2000").index_base == "2000"
    check_aggregation("ratio_of_sums", usd / hour, usd, hour)
    with pytest.raises(ValueError):
        check_aggregation("sum", Unit.index("2000"))
    with pytest.raises(ValueError):
        check_aggregation("sum", a, across_countries=True)
