"""The aggregation registry and unit inference of a calculation."""

import pytest
from fixture import economy

from flowmill.functions.units import Unit, check_aggregation, parsed
from flowmill.operators import indicators
from flowmill.plans import registry
from flowmill.plans.config import methods
from flowmill.plans.run import calculate, recalculate

METHODS = methods()


def rows(**change):
    """The default registry with other rules of one indicator."""
    return [{**r, **change.get(r["indicator"], {})} for r in registry.read_rows()]


def test_units_are_parsed():
    usd, hour = Unit.base("USD", price_basis="current"), Unit.base("hour")
    assert parsed("USD#current/hour") == usd / hour and parsed("1") == Unit.ratio() and parsed("index:2000").index_base == "2000"
    assert parsed("LCU@USA").scope == "USA" and parsed("USD#constant:2005").base_year == 2005 and parsed("person*hour/person") == hour
    for bad in ("metre", "USD current", "LCU", "USD//hour"):
        with pytest.raises(ValueError):
            parsed(bad)


def test_units_follow_the_graph():
    known = {n: parsed(u) for n, u in registry.UNITS.items()}
    units = indicators.inferred(["surplus_emp", "gdp_du", "balance_mv", "transfers_p_m_pc", "multiplier_relative_wages", "profit_us", "comp_share_hs"], known)
    assert units["gdp_du"] == parsed("USD#current") and units["abstract_emp_mv"] == parsed("labour_value") and units["profit_us"] == parsed("USD#current")
    assert units["surplus_emp"] == units["comp_share_hs"] == Unit.ratio()
    with pytest.raises(ValueError, match="balance_mv"):
        indicators.inferred(["balance_mv"], known | {"imports_mv": parsed("USD#current")})
    with pytest.raises(ValueError, match="no unit"):
        indicators.inferred(["balance_mv"], {})
    with pytest.raises(ValueError, match="declared"):
        indicators.inferred(["gdp_du"], known | {"gdp_du": parsed("hour")})


def test_what_can_be_summed():
    for bad in ("1", "index:2000"):
        with pytest.raises(ValueError):
            check_aggregation("sum", parsed(bad))
    with pytest.raises(ValueError):
        check_aggregation("weighted_mean", parsed("USD/hour"), weight=parsed("1"))
    with pytest.raises(ValueError):
        check_aggregation("ratio_of_sums", parsed("USD/hour"), parsed("USD"), parsed("person"))
    with pytest.raises(ValueError):
        check_aggregation("mean", parsed("LCU@A"), across_countries=True)
    assert check_aggregation("mean", parsed("index:2000")).index_base == "2000"


@pytest.mark.parametrize(
    "change, words",
    [
        ({"gdp_us": {"strategy": "weighted_mean", "weight": "nowhere"}}, "nowhere"),
        ({"gdp_us": {"strategy": "ratio_of_sums", "numerator": "go_us", "denominator": "emp"}}, "ratio has unit"),
        ({"surplus_emp": {"strategy": "sum", "module": ""}}, "ratios can't be summed"),
        ({"surplus_emp": {"module": "unknown"}}, "unknown formula"),
        ({"surplus_emp": {"module": "value_of_money"}}, "the formula gives"),
        ({"go_us": {"strategy": "legacy_mean"}}, "typed rules"),
        ({"go_us": {"level": "planet"}}, "level"),
        ({"lfv_emp": {"indicator": "lfv_other"}}, "in the registry"),
    ],
)
def test_bad_rules_stop_before_any_job(spark, change, words):
    e = economy(spark)
    spark.sparkContext.setJobGroup(words, words)
    with pytest.raises(ValueError, match=words):
        calculate(e, METHODS["wiodr13"], rules=rows(**change))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(words)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_missing_level_and_a_strange_header_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="both levels"):
        calculate(economy(spark), METHODS["wiodr13"], rules=registry.read_rows()[1:])
    bad = tmp_path / "r.csv"
    bad.write_text("indicator;level\nx;country\n")
    with pytest.raises(ValueError, match="columns"):
        registry.read_rows(bad)


def test_rules_take_effect_and_are_stored(spark):
    e = economy(spark)
    r = calculate(e, METHODS["wiodr13"], rules=rows(emp={"strategy": "mean"}))
    emp = {(x.year, x.country): x.emp for x in r.countries.collect()}
    assert emp[2000, "A"] == 1.0 and emp[2000, "WWW"] == 1.0  # a mean of means, not 2
    stored = registry.sidecar(spark, r.rules)
    registry.reconciled(r.rules, stored)
    with pytest.raises(ValueError, match="changed emp"):
        recalculate(e, METHODS["wiodr13"], r.sectors, 5, sidecar=stored)
    with pytest.raises(ValueError, match="unexpected"):
        registry.reconciled(registry.rules([x for x in registry.read_rows() if x["indicator"] == "emp"]), stored.where("indicator in ('emp', 'go_us')"))
    own = registry.sidecar(spark, registry.rules(registry.read_rows()))
    assert recalculate(e, METHODS["wiodr13"], r.sectors, 5, sidecar=own).count() == r.sectors.count()


def test_legacy_rules_need_consent():
    legacy = [{"indicator": "emp", "level": v, "strategy": "legacy_mean"} for v in ("country", "world")]
    with pytest.raises(ValueError, match="consent"):
        registry.rules(legacy, stable=False)
    assert registry.rules(legacy, stable=False, allow_legacy=True).bindings["emp"].sector.strategy == "mean"
