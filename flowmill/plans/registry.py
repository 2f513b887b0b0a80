"""The aggregation registry of a calculation: rules and units, checked before any job.

A registry is a ``;`` separated file with a line per indicator and level. Direct rules become columns of one
aggregation a level; formulas follow from both levels' totals. Units of raw columns and of what flows give are
declared; those of all other indicators are inferred over the indicator graph, and every rule must fit them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.aggspec import Binding, reconcile, resolve
from flowmill.functions.safe import divide
from flowmill.functions.units import Unit, check_aggregation, parsed
from flowmill.operators import indicators

#: Header of a registry file (fixed values).
HEADER = ("indicator", "level", "strategy", "numerator", "denominator", "weight", "zero_denominator", "module", "missing")
DEFAULT = Path(__file__).with_name("aggregation.csv")
#: Units of raw accounts and of the columns that flows give.
UNITS = {
    "go_us": "USD#current", "gdp_us": "USD#current", "comp_emp": "USD#current", "comp_empe": "USD#current", "comp_hs": "USD#current", "comp_ms": "USD#current", "capital": "USD#current", "exports_us": "USD#current", "imports_us": "USD#current",
    "emp": "person", "empe": "person", "hours_emp": "hour", "hours_empe": "hour", "hours_hs": "hour", "hours_ms": "hour", "productive": "1",
    "go_mv": "labour_value", "lfv_emp": "labour_value", "lfv_empe": "labour_value", "exports_mv": "labour_value", "imports_mv": "labour_value", "transfers_mv": "labour_value", "transfers_p_mv": "labour_value", "value_m_mv": "labour_value/USD#current",
}


@dataclass(frozen=True)
class Formula:
    """A country and world result from totals of the same level."""

    needs: tuple[str, ...]
    make: Callable[[], Column]
    unit: Callable[..., Unit]


def over(top: str, bottom: str, minus: float = 0.0) -> Formula:
    return Formula((top, bottom), lambda: divide(top, bottom, "not_applicable") - F.lit(minus), indicators.ratio if minus else indicators.over_)


FORMULAS = {
    "abstract_labour_per_person": over("abstract_emp_mv", "emp"), "labour_force_value_per_person": over("lfv_emp", "emp"), "surplus_value": over("abstract_emp_mv", "lfv_emp", 1.0),
    "value_of_money": over("go_mv", "go_us"), "transfers_over_gdp": over("transfers_p_mv", "gdp_mv"), "output_per_person": over("go_us", "emp"),
}


@dataclass(frozen=True)
class Rules:
    bindings: dict[str, Binding]

    @property
    def direct(self) -> dict[str, Binding]:
        return {i: b for i, b in self.bindings.items() if b.sector.strategy != "formula"}

    @property
    def formulas(self) -> dict[str, Formula]:
        return {i: FORMULAS[b.sector.module] for i, b in self.bindings.items() if b.sector.strategy == "formula"}

    def operands(self) -> set[str]:
        """Columns that the sector table must have."""
        return {o for b in self.direct.values() for o in b.sector.operands if o}


def read_rows(path: str | Path = DEFAULT) -> list[dict]:
    lines = [line.split(";") for line in Path(path).read_text("utf-8").splitlines() if line.strip() and not line.startswith("#")]
    if not lines or tuple(lines[0]) != HEADER or any(len(x) != len(HEADER) for x in lines):
        raise ValueError(f"{path}: a registry has the columns {';'.join(HEADER)}")
    return [dict(zip(HEADER, x)) for x in lines[1:]]


def rules(rows: list[dict], stable: bool = True, allow_legacy: bool = False) -> Rules:
    bound = resolve(rows, stable, allow_legacy)
    for i, b in bound.items():
        for spec in (b.sector, b.country):
            if spec.strategy == "formula" and spec.module not in FORMULAS:
                raise ValueError(f"{i}: unknown formula {spec.module}")
    out = Rules(bound)
    for i, f in out.formulas.items():
        if lacking := [n for n in f.needs if n not in out.direct]:
            raise ValueError(f"{i}: its formula needs {lacking} in the registry")
    for i, b in out.direct.items():
        if lacking := [o for o in b.country.operands if o and o not in out.direct]:
            raise ValueError(f"{i}: the world's rule needs {lacking} at country level")
    return out


def checked(found: Rules, raw: set[str], names: list[str], given: tuple[str, ...] = (), declared: dict[str, str] | None = None) -> dict[str, Unit]:
    """Units of all columns of a calculation with ``raw`` columns and the indicators ``names``; an error if a rule rests
    on a column that there is not, or doesn't fit its units. ``declared``: units of further columns."""
    known = {n: parsed(u) for n, u in {**UNITS, **(declared or {})}.items() if n in raw or n in (declared or {})}
    units = indicators.inferred(names, {n: u for n, u in known.items() if n in raw or n not in indicators.REGISTRY} | {g: Unit.ratio() for g in given}, given)
    if lacking := sorted(found.operands() - units.keys()):
        raise ValueError(f"the registry's rules need {lacking}, which the calculation doesn't give or has no unit of")
    for i, b in found.direct.items():
        for spec, world in ((b.sector, False), (b.country, True)):
            u = {k: units.get(getattr(spec, k)) for k in ("numerator", "denominator", "weight") if getattr(spec, k)}
            own = units.get(i) or (u["numerator"] / u["denominator"] if len(u) == 2 else None)
            if spec.strategy == "not_applicable":
                continue
            if own is None:
                raise ValueError(f"{i}: no unit")
            try:
                check_aggregation(spec.strategy, own, across_countries=world, **u)
            except ValueError as e:
                raise ValueError(f"{i}: {e}") from None
            units.setdefault(i, own)
    for i, f in found.formulas.items():
        try:
            got = f.unit(*(units[n] for n in f.needs))
        except ValueError as e:
            raise ValueError(f"{i}: {e}") from None
        if i in units and units[i] != got:
            raise ValueError(f"{i}: sectors have {units[i]}, the formula gives {got}")
        units[i] = got
    return units


def sidecar(spark: SparkSession, found: Rules) -> DataFrame:
    """The rules as a table, to be stored beside a result."""
    rows = [(i, level, s.strategy, s.value, s.numerator, s.denominator, s.weight, s.zero, s.module, s.missing) for i, b in sorted(found.bindings.items()) for level, s in (("country", b.sector), ("world", b.country))]
    return spark.createDataFrame(rows, "indicator string, level string, strategy string, value string, numerator string, denominator string, weight string, zero_denominator string, module string, missing string")


def reconciled(found: Rules, stored: DataFrame) -> None:
    """An error if the stored rules of a result are not those of ``found``. One row per indicator and level."""
    rows = [r.asDict() for r in stored.drop("value").collect()]
    if off := reconcile(found.bindings, resolve(rows, False, True)):
        raise ValueError(f"the result was made by other rules: {', '.join(off)}")
