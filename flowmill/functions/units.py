"""Unit algebra, checked while a plan is built and never per row.

A dimension is a vector of integer exponents over base units with attributes that must agree
where amounts are added: price basis, base year, index base and, for local currency, the country.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: Base units (fixed values).
BASES = ("USD", "LCU", "person", "hour", "labour_value")


@dataclass(frozen=True)
class Unit:
    exponents: tuple[tuple[str, int], ...] = ()
    scope: str | None = None
    price_basis: str | None = None
    base_year: int | None = None
    index_base: str | None = None
    kind: str = field(default="amount", compare=False)

    @staticmethod
    def base(name: str, **attributes) -> Unit:
        if name not in BASES:
            raise ValueError(f"unknown base {name}")
        if name == "LCU" and not attributes.get("scope"):
            raise ValueError("local currency needs a scope")
        return Unit(((name, 1),), **attributes)

    @staticmethod
    def ratio() -> Unit:
        return Unit(kind="ratio")

    @staticmethod
    def index(base: str) -> Unit:
        return Unit(index_base=base, kind="index")

    def power(self, name: str) -> int:
        return dict(self.exponents).get(name, 0)

    def addable(self, other: Unit) -> bool:
        return self == other

    def __add__(self, other: Unit) -> Unit:
        if not self.addable(other):
            raise ValueError(f"can't add {self} and {other}")
        return self

    def _combined(self, other: Unit, sign: int) -> Unit:
        if self.power("LCU") and other.power("LCU") and self.scope != other.scope:
            raise ValueError("local currencies of different countries")
        powers = {b: self.power(b) + sign * other.power(b) for b in BASES}
        exponents = tuple((b, p) for b, p in powers.items() if p)
        money = any(b in ("USD", "LCU") for b, _ in exponents)
        basis = {u.price_basis for u in (self, other) if u.price_basis}
        if money and len(basis) > 1:
            raise ValueError("different price bases")
        years = {u.base_year for u in (self, other) if u.base_year}
        return Unit(exponents, (self.scope or other.scope) if powers["LCU"] else None, next(iter(basis), None) if money else None, next(iter(years), None) if money and len(years) == 1 else None)

    def __mul__(self, other: Unit) -> Unit:
        return self._combined(other, 1)

    def __truediv__(self, other: Unit) -> Unit:
        return self._combined(other, -1)

    def rebased(self, base: str) -> Unit:
        if self.index_base is None:
            raise ValueError("only an index can be rebased")
        return replace(self, index_base=base)


def parsed(text: str) -> Unit:
    """A unit from its text: ``1``, ``index:2000``, or bases with ``*`` and ``/`` in between; a base may carry
    attributes, as in ``LCU@USA`` (scope), ``USD#current`` (price basis) or ``USD#constant:2000`` (and base year)."""
    text = text.strip()
    if text == "1":
        return Unit.ratio()
    if text.startswith("index:"):
        return Unit.index(text[6:])
    out, sign = None, 1
    for part in re.split("([*/])", text):
        if part in ("*", "/"):
            sign = 1 if part == "*" else -1
            continue
        m = re.fullmatch(r"\s*(\w+)(?:@(\w+))?(?:#(\w+)(?::(\d+))?)?\s*", part)
        if not m:
            raise ValueError(f"bad unit {text!r}")
        base = Unit.base(m[1], scope=m[2], price_basis=m[3], base_year=int(m[4]) if m[4] else None)
        out = (base if sign > 0 else Unit() / base) if out is None else (out * base if sign > 0 else out / base)
    return out


def check_aggregation(strategy: str, unit: Unit, numerator: Unit | None = None, denominator: Unit | None = None, weight: Unit | None = None, across_countries: bool = False) -> Unit:
    """The unit of a roll-up, or an error: sums need addable amounts (no index, no ratio, no local currency
    across countries); a ratio of sums must have the indicator's own unit; weights must be addable."""
    for u in (unit if strategy == "sum" else None, *((numerator, denominator) if strategy == "ratio_of_sums" else ()), weight if strategy == "weighted_mean" else None):
        if u is None:
            continue
        if u.index_base is not None:
            raise ValueError("indices can't be summed")
        if not u.exponents:
            raise ValueError("ratios can't be summed")
        if across_countries and u.power("LCU"):
            raise ValueError("local currencies can't be summed across countries")
    if strategy in ("mean", "weighted_mean") and across_countries and unit.power("LCU"):
        raise ValueError("local currencies of different countries have no mean")
    if strategy == "ratio_of_sums":
        got = numerator / denominator
        if got.exponents != unit.exponents:
            raise ValueError(f"ratio has unit {got.exponents}, not {unit.exponents}")
    return unit


#: Display and source scales of amounts: millions of money and hours, thousands of persons, per cents of indices (fixed values).
SCALES = {"million": 1e6, "thousand": 1e3, "unit": 1.0, "per_cent": 0.01}
