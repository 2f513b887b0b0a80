"""A full calculation and its recalculation, as a plan over long tables.

Stages: 0 raw columns, 1 derived from raw, 2 assumptions and abstract labour, 4 from matrices,
5 from sector results; then roll-ups. Tables of label size that later stages read more than once (the
prepared accounts, lambda, flows by destination, the sector table) are written once each; the rest is one
lazy plan over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.aggspec import AggSpec, Binding
from flowmill.functions.keep import kept
from flowmill.operators import assumptions as A
from flowmill.operators import capital, flows, indicators, leontief, rollup
from flowmill.plans import registry
from flowmill.plans.config import Method, admitted

STAGES = (1, 4, 5)


@dataclass
class Economy:
    """What a calculation starts from. ``productive`` maps a sector column to a condition.

    ``row``: the region that stands for the rest of the world, if there is one to fill. ``jobs``: (year,
    total) persons of it. ``wage_shares``: (country, year, percent) of wage workers, the region's among
    them. ``capital_countries``: whose capital per value added the reduction methods give the region.
    ``capital``: composition, rates and capital types of ``capital.depreciation``.
    """

    flows: DataFrame
    accounts: DataFrame
    productive: object
    demand: str = "HH"
    hours: str = "hours_emp"
    output: str = "go_us"
    money_scale: float = 1.0
    row: str | None = None
    jobs: DataFrame | None = None
    wage_shares: DataFrame | None = None
    capital_countries: tuple[str, ...] = ()
    capital: tuple[DataFrame, DataFrame, DataFrame] | None = None


@dataclass
class Results:
    sectors: DataFrame
    bilateral: DataFrame
    countries: DataFrame
    valued: DataFrame
    lam: DataFrame
    coefficients: DataFrame
    labour: DataFrame
    diagnostics: DataFrame
    rules: registry.Rules


def sum_of(name: str) -> Binding:
    return Binding(name, AggSpec("sum", name), AggSpec("sum", name))


def needed(value, what: str, method: Method):
    if value is None or value == ():
        raise ValueError(f"{method.name} needs {what}")
    return value


def _row(e: Economy, t: DataFrame, m: Method) -> DataFrame:
    return A.rest_of_world(t, needed(e.jobs, "the region's jobs", m), e.row)


def _row_old(e: Economy, t: DataFrame, m: Method) -> DataFrame:
    return A.rest_of_world(t, needed(e.jobs, "the region's jobs", m), e.row, exclude_row=False, basis="emp")


def _row_reduction(e: Economy, t: DataFrame, m: Method) -> DataFrame:
    shares = needed(e.wage_shares, "shares of wage workers", m).where(F.col("country") == e.row)
    t = A.wage_shares(_row(e, t, m), shares)
    if {"share_hs", "share_ms"} <= set(t.columns):
        t = A.skill_shares_from_mean(t.drop("share_ls"), e.row)
    return A.capital_from_list(A.compensation_spread(t, row=e.row), list(needed(e.capital_countries, "capital countries", m)), e.row)


def _wage_share(e: Economy, t: DataFrame, m: Method) -> DataFrame:
    shares = needed(e.wage_shares, "shares of wage workers", m)
    return A.wage_shares(t, shares if e.row is None else shares.where(F.col("country") != e.row))


def _without_region(e: Economy, t: DataFrame, m: Method) -> DataFrame:
    return A.without_region(t, [c for c in ("emp", "empe", "hours_emp", "hours_empe", "comp_emp", "comp_empe", "capital") if c in t.columns], e.row)


#: What a method's assumption does, and whether it is about the region (and void without one).
ASSUMPTIONS = {"wage_share": (_wage_share, False), "row": (_row, True), "row_old": (_row_old, True), "row_reduction": (_row_reduction, True), "without_region": (_without_region, True)}


def prepared(e: Economy, method: Method) -> DataFrame:
    """Stages 0 to 2 with the method's assumptions, in their order."""
    t = e.accounts.withColumn("productive", e.productive(F.col("sector")).cast("double"))
    for name in method.assumptions:
        if name not in ASSUMPTIONS:
            raise ValueError(f"{method.name}: unknown assumption {name}")
        apply, regional = ASSUMPTIONS[name]
        if not regional or e.row is not None:
            t = apply(e, t, method)
    t = indicators.with_indicators(t, [method.multiplier]).withColumn(MULTIPLIER[0], F.col(method.multiplier))
    return kept(indicators.with_indicators(t, ["abstract_emp_mv", "gdp_mv", "gdp_p_us"], MULTIPLIER), "prepared")


#: Where abstract labour finds the method's multiplier; later stages take it as it is.
MULTIPLIER = ("multiplier_one",)


def depreciation(e: Economy, method: Method) -> DataFrame | None:
    """Capital depreciation as flows, by the method's way and year of the rates."""
    if e.capital is None or method.depreciation == "zero":
        return None
    return capital.depreciation(*e.capital, year_offset=method.year_offset)


def system(e: Economy, method: Method, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coefficients with row and column numbers, and labour requirements."""
    labour = kept(leontief.labelled(leontief.direct_labour(t, "abstract_emp_mv", e.output, e.productive)), "labour")
    return leontief.system(leontief.input_flows(e.flows, depreciation(e, method)), labour), labour


def values(e: Economy, method: Method, t: DataFrame):
    """Coefficients, labour requirements and lambda. The solution (a row for each industry and year) is kept; what needs
    valued flows too takes ``revalued``."""
    c, labour = system(e, method, t)
    return c, labour, leontief.lambda_of(kept(leontief.solution(c, labour), "solution"))


def revalued(e: Economy, lam: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valued flows with transfers, and the same summed by destination country. The sums are kept: every later
    table is made from them, and none from the valued cells again."""
    valued = flows.with_lambda(e.flows, lam)
    sums = kept(flows.by_destination(valued), "traded")
    bf = flows.balance_factor(sums, e.productive(F.col("o_sector")))
    return flows.with_transfers(valued, bf), flows.with_transfers(sums, bf)


def from_matrices(e: Economy, t: DataFrame, lam: DataFrame, traded: DataFrame, basket: str) -> DataFrame:
    """Stage 4: sums of ``traded`` (flows by destination country) joined to the sector table."""
    p = e.productive(F.col("o_sector"))
    mv = traded.groupBy(*flows.ORIGIN).agg(F.sum("worth").alias("go_mv")).withColumnsRenamed({"o_country": "country", "o_sector": "sector"})
    sums = {"us": F.col("value"), "mv": F.col("worth"), "tr": F.col("transfer"), "trp": F.when(p, F.col("transfer")).otherwise(0.0)}
    out = flows.exports(traded, {f"x_{k}": c for k, c in sums.items()})
    inn = flows.imports(traded, {f"m_{k}": c for k, c in sums.items()})
    t = flows.by_industry(t, mv, out, inn)
    t = t.withColumns({"exports_us": F.col("x_us"), "exports_mv": F.col("x_mv"), "imports_us": F.col("m_us"), "imports_mv": F.col("m_mv"), "transfers_mv": F.col("x_tr") - F.col("m_tr"), "transfers_p_mv": F.col("x_trp") - F.col("m_trp")})
    t = t.drop(*(f"{s}_{k}" for s in "xm" for k in sums))
    b = capital.national_basket(e.flows, e.demand) if basket == "national" else capital.international_basket(e.flows, e.demand)
    lfv = capital.labour_force_value(b, lam, t, "comp_emp").withColumnRenamed("lfv", "lfv_emp")
    t = t.join(lfv, ["year", "country", "sector"], "left")
    return t.join(lam.withColumnRenamed("lam", "value_m_mv"), ["year", "country", "sector"], "left")


LAST = ("gdp_du", "go_du", "abstract_emp_m_mv", "lfv_emp_m_mv", "surplus_emp", "surplus_emp_p", "balance_us", "balance_mv", "transfers_u_mv", "transfers_p_m_pc")


#: What ``from_matrices`` adds to the sector table.
FROM_FLOWS = ("go_mv", "exports_us", "exports_mv", "imports_us", "imports_mv", "transfers_mv", "transfers_p_mv", "lfv_emp", "value_m_mv")


def ruled(e: Economy, method: Method, rows: list[dict] | None, last: tuple[str, ...], allow_experimental: bool) -> registry.Rules:
    """The roll-up rules of a calculation; a missing level, an unknown operand or a wrong unit is an error, and no job has
    run by then. ``rows``: of a registry file, the default one if none are given."""
    found = registry.rules(registry.read_rows() if rows is None else rows, method.status == "stable", allow_experimental)
    raw = {*e.accounts.columns, "productive", *FROM_FLOWS}
    registry.checked(found, raw, [method.multiplier, "abstract_emp_mv", "gdp_mv", "gdp_p_us", *last], MULTIPLIER if method.multiplier not in MULTIPLIER else ())
    return found


def calculate(e: Economy, method: Method, last: tuple[str, ...] = LAST, allow_experimental: bool = False, operation: str = "calculate", rules: list[dict] | None = None) -> Results:
    """A full calculation; disabled methods are refused, experimental ones without consent."""
    admitted([method.name], operation, allow_experimental, {method.name: method})
    found = ruled(e, method, rules, last, allow_experimental)
    t = prepared(e, method)
    c, labour = system(e, method, t)
    solved = kept(leontief.solution(c, labour), "solution")
    lam, (valued, traded) = leontief.lambda_of(solved), revalued(e, leontief.lambda_of(solved))
    t = kept(indicators.with_indicators(kept(from_matrices(e, t, lam, traded, method.basket), "matrices"), list(last), MULTIPLIER), "sectors")
    countries = rollup.two_levels(t, found.direct, {i: f.make for i, f in found.formulas.items()})
    return Results(t, flows.reduced(traded, e.productive(F.col("o_sector"))), countries, valued, lam, c, labour, leontief.diagnostics_of(solved), found)


def recalculate(e: Economy, method: Method, parent: DataFrame, at_stage: int, names: tuple[str, ...] = (), allow_experimental: bool = False, sidecar: DataFrame | None = None) -> DataFrame:
    """Sector results of a child run. ``sidecar``: the parent's stored rules, which must be those in force. Stage 1 starts over; stage 4 takes lambda from the parent's
    value_m_mv; stage 5 computes the named indicators (all, if none) from the parent's columns.
    Columns that are not named stay as they are."""
    admitted([method.name], "recalculate", allow_experimental, {method.name: method})
    if at_stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    if sidecar is not None:
        registry.reconciled(ruled(e, method, None, LAST, allow_experimental), sidecar)
    if at_stage == 1:
        if names:
            raise ValueError("stage 1 takes no indicator names")
        return calculate(e, method, allow_experimental=allow_experimental).sectors
    unknown = [n for n in names if n not in indicators.REGISTRY and n not in parent.columns]
    if unknown:
        raise ValueError(f"unknown indicators {unknown}")
    if at_stage == 4:
        lam = parent.select("year", "country", "sector", F.col("value_m_mv").alias("lam"))
        t = prepared(e, method)
        fresh = indicators.with_indicators(from_matrices(e, t, lam, revalued(e, lam)[1], method.basket), list(LAST), MULTIPLIER)
    else:
        early = [n for n in names if indicators.REGISTRY[n].stage < 5]
        if early:
            raise ValueError(f"{early} belong to an earlier stage")
        keep = [c for c in parent.columns if c not in LAST]
        fresh = indicators.with_indicators(parent.select(*keep), list(names or LAST), MULTIPLIER)
    if not names:
        return fresh
    keys = ["year", "country", "sector"]
    return parent.drop(*names).join(fresh.select(*keys, *names), keys)
