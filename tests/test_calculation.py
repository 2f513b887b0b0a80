import hashlib
import os
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from fixture import LAMBDA, OUTPUT, TRADE, economy
from pyspark.sql import functions as F

from flowmill.functions.keep import kept, released
from flowmill.operators import assumptions, leontief, validation
from flowmill.plans.config import METHOD_COLUMNS, Method, methods
from flowmill.plans.run import LAST, calculate, prepared, recalculate

METHODS = methods()


@pytest.fixture(scope="module")
def results(spark):
    return calculate(economy(spark), METHODS["wiodr13"])


def test_labour_values_and_output(results):
    rows = results.sectors.select("year", "country", "value_m_mv", "go_mv").collect()
    assert {(r.year, r.country) for r in rows} == set(LAMBDA)
    for r in rows:
        assert r.value_m_mv == pytest.approx(LAMBDA[r.year, r.country], rel=1e-12)
        assert r.go_mv == pytest.approx(OUTPUT[r.year, r.country], rel=1e-12)


def test_trade(results):
    rows = {(r.year, r.origin, r.destination): r for r in results.bilateral.collect()}
    for key, (values, transfers) in TRADE.items():
        assert rows[key].exports_values == pytest.approx(values, rel=1e-12)
        assert rows[key].transfers_values == pytest.approx(transfers, rel=1e-12)
    assert all(r.exports_values == 0 and r.transfers_values == 0 for k, r in rows.items() if k[1] == k[2])
    for year in (2000, 2001):
        assert sum(r.transfers_values for k, r in rows.items() if k[0] == year) == pytest.approx(0, abs=1e-12)


def test_checks_pass(results):
    ledger = validation.ledger(validation.row_sums(results.valued, results.sectors), validation.zero_diagonal(results.bilateral, ["exports_values"]), validation.transfers_cancel(results.bilateral), validation.diagnostics_profile(results.diagnostics))
    assert [r.status for r in ledger.collect()] == ["passed"] * 4


def test_damage_is_found(results):
    bad = results.sectors.withColumn("go_mv", F.col("go_mv") * 1.01)
    assert validation.row_sums(results.valued, bad).first().status == "failed"


def test_recalculation_equals_parent(spark, results, tmp_path):
    parent_path = str(tmp_path / "parent")
    results.sectors.write.parquet(parent_path)
    parent = spark.read.parquet(parent_path)
    want = {(r.year, r.country): r.asDict() for r in parent.collect()}
    for stage in (4, 5):
        got = recalculate(economy(spark), METHODS["wiodr13"], parent, stage)
        for r in got.collect():
            for k, v in r.asDict().items():
                assert v == pytest.approx(want[r.year, r.country][k], rel=1e-12) if isinstance(v, float) else v == want[r.year, r.country][k]
    one = recalculate(economy(spark), METHODS["wiodr13"], parent.withColumn("gdp_du", F.lit(0.0)), 5, ("gdp_du",))
    assert all(r.gdp_du == pytest.approx(want[r.year, r.country]["gdp_du"]) for r in one.collect())
    with pytest.raises(ValueError):
        recalculate(economy(spark), METHODS["wiodr13"], parent, 1, ("gdp_du",))
    with pytest.raises(ValueError):
        recalculate(economy(spark), METHODS["wiodr13"], parent, 5, ("gdp_mv",))
    with pytest.raises(ValueError):
        recalculate(economy(spark), METHODS["wiodr13"], parent, 3)
    assert set(LAST) <= set(parent.columns)


C3 = np.array([[0.10, 0.30], [0.05, 0.20]])


def test_solve_is_transposed():
    lam, d = leontief.solve_block(C3, np.array([2.0, 1.0]))
    assert np.allclose(lam, np.linalg.solve((np.eye(2) - C3).T, [2, 1]), rtol=1e-15)
    assert not np.allclose(lam, np.linalg.solve(np.eye(2) - C3, [2, 1]))
    assert d["status"] == "ok" and d["certificate_type"] == "productivity_nonnegative" and d["certificate_ratio_upper"] < 1


def test_singular_and_signed_systems():
    with pytest.raises(np.linalg.LinAlgError):
        leontief.solve_block(np.diag([1.0, 0.2]), np.ones(2))
    assert leontief.certificate(np.diag([1.2, 0.2]))["certificate_margin"] < 0
    c = leontief.certificate(np.array([[0.1, -0.2], [0.05, 0.1]]))
    assert c["certificate_type"] == "absolute_convergence_signed" and 0 < c["certificate_ratio_upper"] < 1 and c["certificate_margin"] > 0


@pytest.mark.parametrize("n", [1, 2, 31, 33, 150])
def test_stored_factors(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    f, b, inverse = leontief.Factors(a), rng.normal(size=(n, 3)), np.linalg.inv(a)
    size = np.linalg.cond(a) * 1e-13
    assert np.allclose(f.solve(b), inverse @ b, rtol=size, atol=size) and np.allclose(f.solve_transposed(b[:, 0]), inverse.T @ b[:, 0], rtol=size, atol=size)
    norm = np.abs(inverse).sum(1).max()
    assert norm / 3 <= f.inverse_norm() <= norm * (1 + size)
    with pytest.raises(np.linalg.LinAlgError):
        leontief.Factors(np.zeros((n, n)))


def test_condition_is_exact_for_nonnegative_coefficients():
    rng = np.random.default_rng(5)
    c, left = rng.random((60, 60)) / 70, rng.random(60)
    lam, d = leontief.solve_block(c, left)
    m = (np.eye(60) - c).T
    assert d["rcond"] == pytest.approx(1 / (np.abs(m).sum(1).max() * np.abs(np.linalg.inv(m)).sum(1).max()), rel=1e-12)
    assert d["certificate_rcond"] == d["rcond"] and d["forward_error_bound"] == pytest.approx(d["eta_normwise"] / d["rcond"])
    signed = c - 0.004
    lam, d = leontief.solve_block(signed, left)
    assert np.allclose(lam, np.linalg.solve((np.eye(60) - signed).T, left), rtol=1e-13) and d["status"] == "ok" and d["certificate_rcond"] != d["rcond"]


def test_refinement_uses_the_factors(monkeypatch):
    rng = np.random.default_rng(6)
    c, left = rng.random((40, 40)) / 50, rng.random(40)
    exact = np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda m, b: exact(m, b) * (1 + 1e-7))
    lam, d = leontief.solve_block(c, left)
    monkeypatch.undo()
    assert d["refinement_count"] == 1 and d["status"] == "ok" and np.allclose(lam, exact((np.eye(40) - c).T, left), rtol=1e-14)


def test_fingerprint_is_sensitive():
    a = leontief.fingerprint(["A.S", "B.S"], np.array([1 / 3, 0.1]))
    assert a == hashlib.md5(b"A.S\t0.33333333333333331\nB.S\t0.10000000000000001").hexdigest()
    assert a != leontief.fingerprint(["A.S", "B.S"], np.array([np.nextafter(1 / 3, 1), 0.1]))


def test_zero_output_column_drops_out(spark):
    e = economy(spark)
    x = e.accounts.select("year", "country", "sector", F.when(F.col("country") == "B", 0.0).otherwise(F.col("go_us")).alias("x"))
    z = leontief.input_flows(e.flows, None)
    assert {r["class"] for r in leontief.zero_output_scan(z, x).collect()} == {"nonzero/0"}
    assert leontief.coefficients(z, x, e.productive).where("d_country = 'B'").count() == 0


def test_undeclared_missing_depreciation_aborts(spark):
    e = economy(spark)
    dep = e.flows.where("kind = 'industry'").withColumn("value", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="missing depreciation"):
        leontief.input_flows(e.flows, dep).collect()
    assert leontief.input_flows(e.flows, dep, "d_country = d_country").count() == 8


def test_methods_are_gated_and_complete(spark):
    e = economy(spark)
    assert {m.status for m in METHODS.values()} == {"stable", "experimental", "disabled"} and len(METHODS) == 17
    with pytest.raises(PermissionError):
        calculate(e, METHODS["eora26"])
    with pytest.raises(PermissionError):
        calculate(e, METHODS["ochoa_1"])
    with pytest.raises(ValueError, match="unknown assumption"):
        prepared(e, Method("m", "s", assumptions=("nope",)))
    with pytest.raises(ValueError, match="wage workers"):
        prepared(e, METHODS["ochoa_1"])
    with pytest.raises(ValueError, match="jobs"):
        prepared(replace(e, row="B"), METHODS["wiodr13"])
    with pytest.raises(ValueError):
        Method("m", "s", depreciation="odd")


def test_catalogue_is_strict(tmp_path):
    bad = tmp_path / "m.csv"
    bad.write_text("name;source\na;b\n")
    with pytest.raises(ValueError):
        methods(str(bad))
    head = ";".join(METHOD_COLUMNS)
    bad.write_text(f"{head}\na;s;stable;;multiplier_one;national;zero;1\na;s;stable;;multiplier_one;national;zero;1\n")
    with pytest.raises(ValueError, match="twice"):
        methods(str(bad))


def test_multiplier_reaches_later_stages(spark):
    e = replace(economy(spark), wage_shares=spark.createDataFrame([("A", 2000, 50.0)], "country string, year int, percent double"))
    e = replace(e, accounts=e.accounts.withColumns({"empe": F.lit(1.0), "hours_empe": F.col("hours_emp")}))
    one = {(r.year, r.country): r.abstract_emp_mv for r in calculate(e, METHODS["wiodr13"]).sectors.collect()}
    r = calculate(e, METHODS["ochoa_1"], allow_experimental=True)
    got = {(r.year, r.country): r.abstract_emp_mv for r in r.sectors.collect()}
    acc = {(r.year, r.country): r for r in e.accounts.collect()}
    for (y, c), v in got.items():
        wage = {k: a.comp_emp / a.hours_emp for (yy, k), a in acc.items() if yy == y}
        assert v == pytest.approx(one[y, c] * wage[c] / min(wage.values()))
    assert got != one
    halves = {(x.year, x.country): x.hours_empe for x in prepared(e, METHODS["ochoa_1"]).collect()}
    assert halves[2000, "A"] == acc[2000, "A"].hours_emp / 2 and halves[2001, "A"] == acc[2001, "A"].hours_emp


def test_rest_of_world_by_workers_and_spread(spark):
    rows = [(2000, "A", "S", 10.0, 100.0, 50.0, 20.0, 5.0), (2000, "A", "T", 0.0, 0.0, 10.0, 5.0, 0.0), (2000, "B", "S", 5.0, 80.0, 50.0, 40.0, 8.0), (2000, "B", "T", 5.0, 20.0, 30.0, 10.0, 2.0), (2000, "R", "S", 0.0, 0.0, 30.0, 0.0, 0.0), (2000, "R", "T", 0.0, 0.0, 30.0, 0.0, 0.0)]
    acc = spark.createDataFrame(rows, "year int, country string, sector string, emp double, hours_emp double, gdp_us double, capital double, comp_emp double")
    jobs = spark.createDataFrame([(2000, 9.0)], "year int, total double")
    got = {r.sector: r for r in assumptions.rest_of_world(acc, jobs, "R", exclude_row=False, basis="emp").where("country = 'R'").collect()}
    need = {"S": 30 * 15 / 100, "T": 30 * 5 / 40}
    assert got["S"].emp == pytest.approx(9 * need["S"] / sum(need.values())) and got["S"].emp + got["T"].emp == pytest.approx(9)
    assert got["S"].hours_emp == pytest.approx(got["S"].emp * 180 / 15)
    assert got["S"].capital == pytest.approx(got["S"].emp * 20 / 10) and got["T"].capital == pytest.approx(got["T"].emp * 25 / 10)  # A is least; its T has no workers
    spread = {r.sector: r.comp_emp for r in assumptions.compensation_spread(acc, ("comp_emp",), "R").where("country = 'R'").collect()}
    assert sum(spread.values()) == pytest.approx(15 / 140 * 60) and spread["S"] / spread["T"] == pytest.approx((30 * 13 / 15) / (30 * 2 / 5))


def test_bad_years_are_refused(spark):
    labour = spark.createDataFrame([(2000, "A", "S", 1.0, 1.0, True), (2000, "B", "S", 1.0, 1.0, True), (2000, "B", "T", 1.0, 0.0, False)], "year int, country string, sector string, x double, l double, productive boolean")
    cells = lambda *a: spark.createDataFrame([(2000, o, "S", d, "S", v) for o, d, v in a], "year int, o_country string, o_sector string, d_country string, d_sector string, a double")
    got = {(r.country, r.sector): r.lam for r in leontief.solve(cells(("A", "A", 0.1), ("A", "B", 0.3), ("B", "A", 0.05), ("B", "B", 0.2)), labour).collect()}
    want = np.linalg.solve((np.eye(2) - C3).T, [1, 1])
    assert got == {("A", "S"): pytest.approx(want[0]), ("B", "S"): pytest.approx(want[1]), ("B", "T"): 0.0}
    for bad, words in ((cells(("A", "A", 1.0)), "singular"), (cells(("A", "A", 1.2)), "rejected")):
        with pytest.raises(Exception, match=words):
            leontief.solve(bad, labour).collect()
    assert leontief.solve(cells(("A", "A", 1.2)), labour, checked=False).count() == 3
    assert (leontief.matrix(pd.DataFrame({"i": [0, 0, 1], "j": [1, 1, 0], "a": [1.0, 2.0, 3.0]}), 2) == [[0, 3], [3, 0]]).all()


def wide_system(spark, n=30, years=(2000, 2001), low=0.0):
    rng = np.random.default_rng(8)
    names = [f"C{i:02d}" for i in range(n)]
    cells = [(y, a, "S", b, "S", float(rng.random() * 0.3 / n + low)) for y in years for a in names for b in names if rng.random() < 0.7]
    rows = [(y, a, "S", 1.0 + rng.random(), float(rng.random()), True) for y in years for a in names] + [(y, "C00", "U", 0.0, 0.0, False) for y in years]
    flows = spark.createDataFrame(cells, "year int, o_country string, o_sector string, d_country string, d_sector string, a double")
    return flows, spark.createDataFrame(rows, "year int, country string, sector string, x double, l double, productive boolean")


@pytest.mark.parametrize("low", [0.0, -0.002])
def test_rounds_equal_the_dense_solve(spark, low):
    cells, labour = wide_system(spark, low=low)
    dense, rounds = (leontief.solution(cells, labour, limit=k).cache() for k in (1000, 29))
    got, want = ({(r.year, r.country, r.sector): r.lam for r in leontief.lambda_of(t).collect()} for t in (rounds, dense))
    assert got == pytest.approx(want, rel=1e-10) and len(got) == 62 and got[2000, "C00", "U"] == 0
    a, b = ({r.year: r.asDict() for r in leontief.diagnostics_of(t).collect()} for t in (rounds, dense))
    for year in (2000, 2001):
        assert a[year]["status"] == b[year]["status"] == "ok"
        for k, v in b[year].items():
            if k in ("lambda_fingerprint", "absolute_residual_max", "eta_normwise", "berr_componentwise", "sensitivity_estimate", "forward_error_bound"):
                continue  # rounding alone
            if low < 0 and k in ("rcond", "certificate_rcond"):
                assert a[year][k] <= v * 1.001  # a bound of the inverse's norm
            else:
                assert a[year][k] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v), k
    mixed = leontief.solve(cells.where("year = 2000 or o_country < 'C10'"), labour.where("year = 2000 or country < 'C10'"), limit=20)
    assert mixed.where("year = 2000").count() == 31 and mixed.where("year = 2001").count() == 11


def test_rounds_refuse_what_does_not_converge(spark):
    cells, labour = wide_system(spark, 6, (2000,), 0.4)
    with pytest.raises(ValueError, match="does not converge"):
        leontief.in_rounds(*leontief.numbered(cells, labour), most_rounds=6)


def test_published_diagnostics(spark, results, tmp_path):
    rows = leontief.for_method(results.diagnostics, "m1").cache()
    assert tuple(rows.columns) == leontief.COLUMNS and len(leontief.COLUMNS) == 47
    assert leontief.contract_errors(rows, "m1", (2000, 2001)).isEmpty()
    marks = {r.year: r.lambda_fingerprint for r in rows.collect()}
    assert {r.year: r.mark for r in leontief.year_fingerprints(results.lam, "lam").collect()} == marks
    for year in marks:
        lam = sorted((r.country, r.sector, r.lam) for r in results.lam.where(f"year = {year}").collect())
        assert leontief.fingerprint([f"{a}.{b}" for a, b, _ in lam], [v for *_, v in lam]) == marks[year]
    bad = {"labels": ("matrix_scope", F.lit("x")), "policy": ("gamma_n", F.col("gamma_n") * 2), "certificate": ("certificate_margin", F.lit(-1.0)), "condition": ("rcond", F.lit(1e-30)), "dimensions": ("total_dimension", F.lit(9)), "missing or infinite": ("labour_min", F.lit(float("inf")))}
    for problem, (column, value) in bad.items():
        found = {r.problem for r in leontief.contract_errors(rows.withColumn(column, value)).collect()}
        assert problem in found
    assert [(r.year, r.problem) for r in leontief.contract_errors(rows, "m1", (2000, 2001, 2002)).collect()] == [(2002, "absent")]
    assert {r.problem for r in leontief.contract_errors(rows, "m2").collect()} == {"method"}
    with pytest.raises(ValueError, match="repeated"):
        leontief.appended(rows, rows)
    both = leontief.appended(rows, leontief.for_method(results.diagnostics, "m0"))
    assert [(r.method, r.year) for r in both.collect()] == [("m0", 2000), ("m0", 2001), ("m1", 2000), ("m1", 2001)]
    text = rows.select(*(F.regexp_replace(F.col(c).cast("string"), "[.]", ",").alias(c) if t == "double" else c for c, t in rows.dtypes))
    text.coalesce(1).write.csv(str(tmp_path / "d"), sep=";", header=True)
    again = leontief.loaded(spark, str(tmp_path / "d"), "m1", (2000, 2001))
    assert {r.year: r.rcond for r in again.collect()} == {r.year: r.rcond for r in rows.collect()}
    with pytest.raises(ValueError, match="absent"):
        leontief.loaded(spark, str(tmp_path / "d"), "m1", (1999, 2000, 2001))


def test_kept_tables_are_released(spark):
    with released(spark):
        t = kept(spark.range(3), "short")
        path = t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert os.path.isdir(path) and t.count() == 3
    assert not os.path.exists(path)
