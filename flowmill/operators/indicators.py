"""Sector indicators as a registry of column expressions and table joins, run by stage.

An indicator names its stage, the columns it needs and how it is computed from the wide sector
table (year, country, sector, ...). Expression indicators of one stage are added in one projection
pass; indicators from flows arrive as joined columns beforehand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.functions.safe import divide, sequential_ratio
from flowmill.functions.units import Unit

KEYS = ["year", "country", "sector"]
YEAR, PLACE, SERIES = ["year"], ["year", "country"], ["country", "sector"]


@dataclass(frozen=True)
class Indicator:
    name: str
    stage: int
    needs: tuple[str, ...]
    make: Callable[[], Column]
    order: int | None = None
    unit: Callable[..., Unit] | None = None  # from the units of ``needs``, in their order


REGISTRY: dict[str, Indicator] = {}


def indicator(name: str, stage: int, *needs: str, order: int | None = None, unit: Callable[..., Unit] | None = None):
    def add(f):
        REGISTRY[name] = Indicator(name, stage, needs, f, order, unit)
        return f

    return add


def first(a: Unit, *_: Unit) -> Unit:
    """The unit of the first operand: copies, masks and shares of it."""
    return a


def same(*units: Unit) -> Unit:
    """Of sums and differences: all operands must have one unit."""
    out = units[0]
    for u in units[1:]:
        out = out + u
    return out


def over_(a: Unit, b: Unit, *_: Unit) -> Unit:
    return a / b


def ratio(a: Unit, b: Unit, *_: Unit) -> Unit:
    """A pure number: both operands must have one unit."""
    return same(a, b) / b


def number(*_: Unit) -> Unit:
    return Unit.ratio()


def inferred(names: list[str], known: dict[str, Unit], given: tuple[str, ...] = ()) -> dict[str, Unit]:
    """Units of indicators and of all they rest on, from the known units of raw columns; no job is run. Units that
    don't fit, and columns without a unit, are errors."""
    units = dict(known)
    for i in planned(names):
        if i.name in given:
            continue
        lacking = [n for n in i.needs if n not in units]
        if lacking or i.unit is None:
            raise ValueError(f"{i.name}: no unit of {lacking or i.name}")
        try:
            got = i.unit(*(units[n] for n in i.needs))
        except ValueError as e:
            raise ValueError(f"{i.name}: {e}") from None
        if i.name in known and known[i.name] != got:
            raise ValueError(f"{i.name}: declared in {known[i.name]}, computed in {got}")
        units[i.name] = got
    return units


def over(c: Column, keys: list[str]) -> Column:
    return c.over(W.partitionBy(*keys))


def at_year(name: str, year: Column | int, keys: list[str]) -> Column:
    return over(F.max(F.when(F.col("year") == year, F.col(name))), keys)


def planned(names: list[str]) -> list[Indicator]:
    """The indicators and all they rest on, by (stage, order, name) and dependency."""
    done: dict[str, Indicator] = {}

    def visit(n: str, path: tuple = ()):
        if n in path:
            raise ValueError(f"circular indicators {path}")
        if n in done or n not in REGISTRY:
            return
        for need in REGISTRY[n].needs:
            visit(need, (*path, n))
        done[n] = REGISTRY[n]

    for n in sorted(names, key=lambda n: (REGISTRY[n].stage, REGISTRY[n].order if REGISTRY[n].order is not None else 1 << 30, n)):
        visit(n)
    return list(done.values())


def with_indicators(table: DataFrame, names: list[str], given: tuple[str, ...] = ()) -> DataFrame:
    """Adds indicators in dependency order. A raw column that is missing is an error; columns ``given``
    are taken as they are."""
    for i in planned(names):
        if i.name in given:
            continue
        missing = [n for n in i.needs if n not in table.columns]
        if missing:
            raise ValueError(f"{i.name}: no column {missing}")
        table = table.withColumn(i.name, i.make())
    return table


def copied(source: DataFrame, solutions: dict[str, str]) -> DataFrame:
    """Stage 0: raw source columns under indicator names. Scaling strings are rejected."""
    for name, solution in solutions.items():
        if "*" in solution or solution not in source.columns:
            raise ValueError(f"{name}: no source variable {solution}")
    return source.select(*KEYS, *(F.col(s).alias(n) for n, s in solutions.items()))


# stage 1: from raw columns


@indicator("exchange", 1, "gdp_lcu", "gdp_us")
def _exchange():
    """Country rate: sums of value added in local over common currency; USA is exactly 1."""
    rate = divide(over(F.sum("gdp_lcu"), PLACE), over(F.sum("gdp_us"), PLACE), "error")
    bad = (F.col("country") == "USA") & (F.abs(rate - 1) > 1e-7)
    return F.when(bad | (rate <= 0), F.raise_error(F.lit("bad exchange rate")).cast("double")).when(F.col("country") == "USA", 1.0).otherwise(rate)


@indicator("exchange_v09", 1, "gdp_lcu", "gdp_us")
def _exchange_v09():
    """Sector rates; what is not positive takes the mean of the country's valid rates."""
    own = F.try_divide("gdp_lcu", "gdp_us")
    valid = F.when((own > 0) & ~F.isnan(own), own)
    return F.when(F.col("country") == "USA", 1.0).otherwise(F.coalesce(valid, over(F.avg(valid), PLACE)))


@indicator("exchange_id", 1, "exchange")
def _exchange_id():
    """Relative to the first year."""
    return divide("exchange", over(F.min_by("exchange", "year"), SERIES), "not_applicable")


@indicator("comp_emp_us", 1, "lab", "exchange")
def _comp():
    return divide("lab", "exchange", "error")


@indicator("capital_us", 1, "k_gfcf", "gfcf_p", "exchange")
def _capital():
    return divide(F.col("k_gfcf") * F.col("gfcf_p"), F.col("exchange"), "error")


@indicator("capital_cu", 1, "k_gfcf", "go_price", "exchange")
def _capital_cu():
    return sequential_ratio("k_gfcf", [F.col("go_price"), over(F.min_by("exchange", "year"), SERIES)])


@indicator("hours_emp_from_empe", 1, "hours_empe", "empe", "emp")
def _hours():
    """Hours per employee times persons; 0 where no one is employed."""
    return divide("hours_empe", "empe", "zero_if_both_zero") * F.col("emp")


@indicator("go_price", 1, "go_us", "hours_emp")
def _price():
    own = F.try_divide("go_us", "hours_emp")
    return divide(own, over(F.min_by(own, "year"), SERIES), "not_applicable")


@indicator("profit_us", 1, "gdp_us", "comp_emp", unit=same)
def _profit():
    return F.col("gdp_us") - F.col("comp_emp")


# stage 2: reduction to simple labour, abstract labour, value added in labour


@indicator("multiplier_one", 2, unit=number)
def _one():
    return F.lit(1.0)


@indicator("multiplier_skills", 2, "share_hs", "share_ms", unit=same)
def _skills():
    return 6.25 * F.col("share_hs") + 2.5 * F.col("share_ms") + (1 - F.col("share_hs") - F.col("share_ms"))


@indicator("share_hs", 2, "hours_hs", "hours_emp", unit=ratio)
def _share_hs():
    return F.try_divide("hours_hs", "hours_emp")


@indicator("share_ms", 2, "hours_ms", "hours_emp", unit=ratio)
def _share_ms():
    return F.try_divide("hours_ms", "hours_emp")


@indicator("share_hs_reduced", 2, "share_hs", "multiplier_skills", unit=first)
def _share_hs_reduced():
    return F.try_divide(6.25 * F.col("share_hs"), F.col("multiplier_skills"))


def wage() -> Column:
    return F.try_divide("comp_emp", "hours_emp")


@indicator("multiplier_world_wage", 2, "comp_emp", "hours_emp", unit=number)
def _world_wage():
    return F.try_divide(wage(), over(F.min(F.when(wage() > 0, wage())), YEAR))


@indicator("multiplier_national_wage", 2, "comp_emp", "hours_emp", unit=number)
def _national_wage():
    return F.try_divide(wage(), over(F.min(F.when(wage() > 0, wage())), PLACE))


@indicator("multiplier_relative_wages", 2, "comp_emp", "hours_emp", "comp_hs", "hours_hs", "comp_ms", "hours_ms", "share_hs", "share_ms", unit=number)
def _relative_wages():
    """World wages of three skills per year relative to the lowest skill, weighted by hour shares."""
    total = {s: F.try_divide(over(F.sum(f"comp_{s}"), YEAR), over(F.sum(f"hours_{s}"), YEAR)) for s in ("hs", "ms")}
    low = F.try_divide(over(F.sum(F.col("comp_emp") - F.col("comp_hs") - F.col("comp_ms")), YEAR), over(F.sum(F.col("hours_emp") - F.col("hours_hs") - F.col("hours_ms")), YEAR))
    return F.try_divide(total["hs"], low) * F.col("share_hs") + F.try_divide(total["ms"], low) * F.col("share_ms") + (1 - F.col("share_hs") - F.col("share_ms"))


@indicator("abstract_emp_mv", 2, "hours_emp", "multiplier_one", unit=lambda h, m: h * m / Unit.base("hour") * Unit.base("labour_value"))
def _abstract_emp():
    return F.col("hours_emp") * F.col("multiplier_one")


@indicator("abstract_empe_mv", 2, "hours_empe", "multiplier_one", unit=lambda h, m: h * m / Unit.base("hour") * Unit.base("labour_value"))
def _abstract_empe():
    return F.col("hours_empe") * F.col("multiplier_one")


@indicator("gdp_mv", 2, "abstract_emp_mv", "productive", unit=first)
def _gdp_mv():
    return F.col("abstract_emp_mv") * F.col("productive")


@indicator("gdp_p_us", 2, "gdp_us", "productive", unit=first)
def _gdp_p():
    return F.col("gdp_us") * F.col("productive")


# stage 5: ratios of earlier results


@indicator("price_per_value", 5, "go_us", "go_mv", unit=over_)
def _k():
    """World output in prices over values, a year's scalar."""
    return divide(over(F.sum("go_us"), YEAR), over(F.sum("go_mv"), YEAR), "error")


@indicator("gdp_du", 5, "gdp_mv", "price_per_value", unit=lambda v, k: v * k)
def _gdp_du():
    return F.col("gdp_mv") * F.col("price_per_value")


@indicator("go_du", 5, "go_mv", "price_per_value", unit=lambda v, k: v * k)
def _go_du():
    return F.col("go_mv") * F.col("price_per_value")


def _ratio(name: str, stage: int, top: str, bottom: str, minus: float = 0.0):
    @indicator(name, stage, top, bottom, unit=ratio if minus else over_)
    def _make():
        return divide(top, bottom, "not_applicable") - F.lit(minus)


_ratio("abstract_emp_m_mv", 5, "abstract_emp_mv", "emp")
_ratio("abstract_empe_m_mv", 5, "abstract_empe_mv", "empe")
_ratio("lfv_m_mv", 5, "lfv_empe", "empe")
_ratio("lfv_emp_m_mv", 5, "lfv_emp", "emp")
_ratio("surplus_emp", 5, "abstract_emp_mv", "lfv_emp", 1.0)
_ratio("surplus_empe", 5, "abstract_empe_mv", "lfv_empe", 1.0)
_ratio("transfers_p_m_pc", 5, "transfers_p_mv", "gdp_mv")


@indicator("surplus_emp_p", 5, "surplus_emp", "productive", unit=first)
def _surplus_p():
    return F.col("surplus_emp") * F.col("productive")


@indicator("surplus_hs", 5, "abstract_empe_mv", "lfv_empe", "share_hs", "comp_share_hs", unit=lambda a, v, s, c: ratio(a, v))
def _surplus_hs():
    return divide(F.col("abstract_empe_mv") * F.col("share_hs"), F.col("lfv_empe") * F.col("comp_share_hs"), "not_applicable") - 1


@indicator("comp_share_hs", 2, "comp_hs", "comp_emp", unit=ratio)
def _comp_share_hs():
    return F.try_divide("comp_hs", "comp_emp")


@indicator("balance_us", 5, "exports_us", "imports_us", unit=same)
def _balance_us():
    return F.col("exports_us") - F.col("imports_us")


@indicator("balance_mv", 5, "exports_mv", "imports_mv", unit=same)
def _balance_mv():
    return F.col("exports_mv") - F.col("imports_mv")


@indicator("transfers_u_mv", 5, "transfers_mv", "transfers_p_mv", unit=same)
def _transfers_u():
    return F.col("transfers_mv") - F.col("transfers_p_mv")


@indicator("appropriated_profit", 5, "profit_us", "depreciation_us", "capital", unit=lambda p, d, k: ratio(same(p, d), k))
def _appropriated():
    return divide(F.col("profit_us") - F.col("depreciation_us"), F.col("capital"), "not_applicable")


@indicator("comp_emp_cu", 5, "comp_emp", "basket_price")
def _comp_cu():
    return sequential_ratio("comp_emp", [F.col("basket_price")])


@indicator("monetary_rate", 5, "gdp_us", "depreciation_us", "comp_emp", "capital", unit=lambda g, d, c, k: ratio(same(g, d, c), k))
def _monetary_rate():
    return F.try_divide(F.col("gdp_us") - F.col("depreciation_us") - F.col("comp_emp"), F.col("capital"))


def monetary_rate_by_country(sectors: DataFrame) -> DataFrame:
    """Mean of sector rates weighted by capital of 0.01 at least; a missing rate counts as 0."""
    w = F.greatest("capital", F.lit(0.01))
    return sectors.groupBy(*PLACE).agg((F.sum(w * F.coalesce("monetary_rate", F.lit(0.0))) / F.sum(w)).alias("monetary_rate"))


def basket_value(flows_basket: DataFrame, prices: DataFrame, lam: DataFrame, base_year: int) -> DataFrame:
    """(year, country, basket_value): deflated prices times lambda over the base year's basket,
    relative to the base year. ``prices``: (year, country, sector, price)."""
    fixed = flows_basket.where(F.col("year") == base_year).drop("year")
    side = prices.join(lam, KEYS).select("year", F.col("country").alias("o_country"), F.col("sector").alias("o_sector"), (F.col("price") * F.col("lam")).alias("pv"))
    level = side.join(fixed, ["o_country", "o_sector"]).groupBy("year", F.col("d_country").alias("country")).agg(F.sum(F.col("basket") * F.col("pv")).alias("v"))
    base = F.max(F.when(F.col("year") == base_year, F.col("v"))).over(W.partitionBy("country"))
    return level.select("year", "country", F.try_divide("v", base).alias("basket_value"))


@dataclass
class Extension:
    """User indicators: name to (stage, needs, function)."""

    added: dict[str, Indicator] = field(default_factory=dict)

    def register(self, name: str, stage: int, needs: tuple[str, ...], make: Callable[[], Column]) -> None:
        if name in REGISTRY:
            raise ValueError(f"{name} is already registered")
        self.added[name] = REGISTRY[name] = Indicator(name, stage, needs, make)
