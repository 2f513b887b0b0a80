"""Typed aggregation specs compiled to columns.

A spec says how an indicator is rolled up at one level: sum, mean, weighted mean, ratio of sums,
invariant, not applicable, or formula (computed by a module after the direct aggregates).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.safe import is_special

STRATEGIES = ("sum", "mean", "weighted_mean", "ratio_of_sums", "invariant", "not_applicable", "formula")
MISSING = ("available", "propagate", "error")
ZERO = ("error", "not_applicable", "zero")
TOLERANCE = 2.0**-26  # square root of the double epsilon


@dataclass(frozen=True)
class AggSpec:
    """``value`` is the rolled-up column; the others name what a strategy needs besides."""

    strategy: str
    value: str | None = None
    weight: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    missing: str = "available"
    zero: str = "error"
    tolerance: float = TOLERANCE
    order: str | None = None
    module: str | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES or self.missing not in MISSING or self.zero not in ZERO:
            raise ValueError(f"invalid spec {self}")
        need = {"weighted_mean": ("value", "weight"), "ratio_of_sums": ("numerator", "denominator"), "formula": ("module",), "not_applicable": ()}.get(self.strategy, ("value",))
        given = {n for n in ("value", "weight", "numerator", "denominator", "module") if getattr(self, n)}
        extra = given - set(need) - {"value"}
        if not set(need) <= given or extra:
            raise ValueError(f"{self.strategy} takes {need}, got {sorted(given)}")

    @property
    def operands(self) -> tuple[str, ...]:
        return {"weighted_mean": (self.value, self.weight), "ratio_of_sums": (self.numerator, self.denominator), "not_applicable": ()}.get(self.strategy, (self.value,))


def compiled(spec: AggSpec, name: str) -> dict[str, Column]:
    """Aggregates to be computed in one ``agg``: ``name`` (value) and ``name__state``.

    Pairs count only where both operands are there. States: finite, partial, missing,
    zero_denominator, not_applicable.
    """
    if spec.strategy == "not_applicable":
        return {name: F.max(F.lit(None).cast("double")), f"{name}__state": F.max(F.lit("not_applicable"))}
    if spec.strategy == "formula":
        raise ValueError("formulas run after the direct aggregates")
    cols = [F.col(c) for c in spec.operands]
    whole = cols[0].isNotNull() if len(cols) == 1 else cols[0].isNotNull() & cols[1].isNotNull()
    have, all_ = F.count(F.when(whole, 1)), F.count(F.lit(1))
    bad = F.max(sum((is_special(c).cast("int") for c in cols), F.lit(0))) > 0

    def error(text: str) -> Column:
        return F.raise_error(F.lit(f"{name}: {text}")).cast("double")

    zero = None
    if spec.strategy == "sum":
        v = F.sum(cols[0])
    elif spec.strategy == "mean":
        v = F.avg(cols[0])
    elif spec.strategy == "invariant":
        first = F.min_by(cols[0], F.when(whole, F.col(spec.order))) if spec.order else F.min(cols[0])
        low, high, scale = F.min(cols[0]), F.max(cols[0]), F.greatest(F.lit(1.0), F.max(F.abs(cols[0])))
        v = F.when(F.greatest(F.abs(high - first), F.abs(first - low)) > spec.tolerance * scale, error("not invariant")).otherwise(first)
    else:
        if spec.strategy == "weighted_mean":
            top, bottom = F.sum(F.when(whole, cols[0] * cols[1])), F.sum(F.when(whole, cols[1]))
            negative = F.min(F.when(whole, cols[1])) < 0
        else:
            top, bottom = F.sum(F.when(whole, cols[0])), F.sum(F.when(whole, cols[1]))
            negative = F.lit(False)
        zero = bottom == 0
        at_zero = {"error": error("zero denominator"), "not_applicable": F.lit(None).cast("double"), "zero": F.lit(0.0)}[spec.zero]
        v = F.when(negative, error("negative weight")).when(zero, at_zero).otherwise(top / bottom)
    if spec.missing == "error":
        v = F.when(have < all_, error("missing cell")).otherwise(v)
    elif spec.missing == "propagate":
        v = F.when(have == all_, v)
    v = F.when(bad, error("NaN or infinite")).otherwise(v)
    state = F.when(have == 0, "missing").when((have < all_) & F.lit(spec.missing == "propagate"), "missing")
    if zero is not None:
        state = state.when(zero, "not_applicable" if spec.zero == "not_applicable" else "zero_denominator")
    state = state.when(have < all_, "partial").otherwise("finite")
    return {name: v, f"{name}__state": state}


def aggregate(df: DataFrame, keys: list[str], specs: dict[str, AggSpec], states: bool = False) -> DataFrame:
    """All specs of one level in a single aggregation (one shuffle, partial sums map-side)."""
    out: list[Column] = []
    for name, spec in specs.items():
        if spec.strategy != "formula":
            out += [c.alias(n) for n, c in compiled(spec, name).items() if states or n == name]
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def audited(df: DataFrame, keys: list[str], specs: dict[str, AggSpec]) -> DataFrame:
    """``aggregate`` with states and, for sums and means, ``<name>__audit``: whether a plain reduction in
    the same pass gives the same value within the rounding of its terms."""
    out: list[Column] = []
    for name, spec in specs.items():
        out += [c.alias(n) for n, c in compiled(spec, name).items()]
        if spec.strategy in ("sum", "mean"):
            v = F.col(spec.value)
            total = F.sum(F.coalesce(v, F.lit(0.0)))
            plain = total if spec.strategy == "sum" else F.try_divide(total, F.count(v))
            size = F.sum(F.abs(F.coalesce(v, F.lit(0.0))))
            held = compiled(spec, name)[name]
            lacking = held.isNull()
            out.append(F.when(lacking, "no value").when(F.abs(held - plain) <= 2.0**-52 * F.count(F.lit(1)) * size, "equal").otherwise("differs").alias(f"{name}__audit"))
    return df.groupBy(*keys).agg(*out)


@dataclass(frozen=True)
class Binding:
    indicator: str
    sector: AggSpec
    country: AggSpec


def resolve(rows: list[dict], stable: bool = True, allow_legacy: bool = False) -> dict[str, Binding]:
    """A registry from contract rows (indicator, level, strategy, numerator, denominator, weight,
    zero_denominator, module).

    Stable methods need a typed row at both levels; experimental ones may use legacy means, with consent.
    Both levels agree on formula; a direct world rule may not rest on a formula's result.
    """
    by: dict[str, dict[str, AggSpec]] = {}
    for r in rows:
        level = r["level"]
        if level not in ("country", "world") or level in by.setdefault(r["indicator"], {}):
            raise ValueError(f"bad or repeated level {level} of {r['indicator']}")
        legacy = r["strategy"] == "legacy_mean" or r.get("legacy")
        if legacy and (stable or not allow_legacy):
            raise ValueError(f"{r['indicator']}: a stable method takes typed rules alone" if stable else f"{r['indicator']}: legacy rule without consent")
        strategy = {"legacy_mean": "mean"}.get(r["strategy"], r["strategy"])
        fields = {k: r.get(k) or None for k in ("numerator", "denominator", "weight", "module")}
        by[r["indicator"]][level] = AggSpec(strategy, None if strategy in ("ratio_of_sums", "not_applicable", "formula") else r["indicator"], missing=r.get("missing") or "available", zero=r.get("zero_denominator") or "error", **fields)
    formulas = {i for i, b in by.items() if any(s.strategy == "formula" for s in b.values())}
    for i, b in by.items():
        if set(b) != {"country", "world"}:
            raise ValueError(f"{i}: both levels must be given")
        if (b["country"].strategy == "formula") != (b["world"].strategy == "formula"):
            raise ValueError(f"{i}: levels disagree on formula")
        if i not in formulas and formulas & {o for o in b["world"].operands if o}:
            raise ValueError(f"{i}: a direct rule rests on a formula")
    return {i: Binding(i, b["country"], b["world"]) for i, b in by.items()}


def reconcile(registry: dict[str, Binding], sidecar: dict[str, Binding]) -> list[str]:
    """Differences between a registry and its stored copy, both ways; empty if they agree."""
    return sorted([f"missing {i}" for i in registry.keys() - sidecar.keys()] + [f"unexpected {i}" for i in sidecar.keys() - registry.keys()] + [f"changed {i}" for i in registry.keys() & sidecar.keys() if registry[i] != sidecar[i]])
