"""Configuration: catalog tables with constraints, three-layer parameters, access rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How names of methods, runs and indicators are written (fixed value).
SAFE_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")
CHANNEL = re.compile(r"^[a-z][a-z0-9-]{0,31}$")
STATUSES = ("stable", "experimental", "disabled")
BASKETS = ("national", "international")
DEPRECIATIONS = ("composition", "zero")


def safe_name(value: str) -> bool:
    return bool(SAFE_NAME.match(value)) and ".." not in value


def safe_reference(value: str) -> bool:
    """A relative path of safe names."""
    return bool(value) and all(safe_name(p) for p in value.split("/"))


def valid_channel(value: str) -> bool:
    return bool(CHANNEL.match(value))


@dataclass(frozen=True)
class Row:
    """A line of an indicator table: which solution, at which stage and in which order."""

    names: str
    sector_solution: str
    country_solution: str = ""
    stage: int = 0
    order: int | None = None


def effective(*layers: list[Row]) -> list[Row]:
    """Method over source over common: the first definition of a name wins; then by stage, order
    (missing last) and place."""
    seen: dict[str, tuple[Row, int]] = {}
    for layer in layers:
        for row in layer:
            if row.names not in seen:
                seen[row.names] = (row, len(seen))
    return [r for r, k in sorted(seen.values(), key=lambda p: (p[0].stage, p[0].order is None, p[0].order or 0, p[1]))]


@dataclass(frozen=True)
class Method:
    name: str
    source: str
    status: str = "stable"
    operations: tuple[str, ...] = ("calculate", "recalculate", "prepare")
    assumptions: tuple[str, ...] = ()
    basket: str = "national"
    multiplier: str = "multiplier_one"
    depreciation: str = "composition"
    year_offset: int = 1
    rows: tuple[Row, ...] = field(default=())

    def __post_init__(self):
        if not safe_name(self.name) or self.status not in STATUSES:
            raise ValueError(f"bad method {self.name} ({self.status})")
        if self.basket not in BASKETS or self.depreciation not in DEPRECIATIONS or not self.multiplier.startswith("multiplier_"):
            raise ValueError(f"bad method {self.name}: basket {self.basket}, depreciation {self.depreciation}, multiplier {self.multiplier}")


def methods(path: str | None = None) -> dict[str, Method]:
    """The methods of a catalogue file, by name; that of this package if no path is given.

    One header line with exactly the expected columns, one line a method, comments after ``#``. The file
    is a driver-side configuration of a few lines, so it is read without a job.
    """
    text = open(path, encoding="utf-8").read() if path else resources.files("flowmill.plans").joinpath("methods.csv").read_text("utf-8")
    header, *lines = [line.split(";") for line in text.splitlines() if line.strip() and not line.startswith("#")]
    if header != METHOD_COLUMNS or any(len(line) != len(header) for line in lines):
        raise ValueError(f"the catalogue must have the columns {METHOD_COLUMNS}")
    found = {}
    for line in lines:
        row = dict(zip(header, line))
        if row["name"] in found:
            raise ValueError(f"{row['name']} is listed twice")
        found[row["name"]] = Method(**{**row, "assumptions": tuple(a for a in row["assumptions"].split(",") if a), "year_offset": int(row["year_offset"])})
    return found


METHOD_COLUMNS = ["name", "source", "status", "assumptions", "multiplier", "basket", "depreciation", "year_offset"]


def admitted(names: list[str], operation: str, allow_experimental: bool = False, catalog: dict[str, Method] | None = None) -> list[Method]:
    """Methods that may run: known, enabled, capable, and experimental ones only with consent."""
    out, catalog = [], methods() if catalog is None else catalog
    for name in names:
        m = catalog.get(name)
        if m is None:
            raise ValueError(f"unknown method {name}")
        if m.status == "disabled":
            raise PermissionError(f"{name} is disabled")
        if m.status == "experimental" and not allow_experimental:
            raise PermissionError(f"{name} is experimental")
        if operation not in m.operations:
            raise PermissionError(f"{name} can't {operation}")
        out.append(m)
    if len({m.name for m in out}) != len(out):
        raise ValueError("a method is named twice")
    return out


def catalog_errors(table: DataFrame, name: str, key: list[str], required: list[str] = (), enums: dict[str, list[str]] | None = None, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(table, rule, value) of every violated constraint: empty required cells, repeated keys,
    values outside an enumeration, references to absent keys."""
    label = F.concat_ws("|", *key)
    parts = [table.groupBy(label.alias("value")).count().where("count > 1").select(F.lit("repeated key").alias("rule"), "value")]
    parts += [table.where(F.col(c).isNull() | (F.trim(c) == "")).select(F.lit(f"{c} is required").alias("rule"), label.alias("value")) for c in required]
    parts += [table.where(~F.col(c).isin(v)).select(F.lit(f"{c} not in enumeration").alias("rule"), F.col(c).cast("string").alias("value")) for c, v in (enums or {}).items()]
    for c, (other, column) in (references or {}).items():
        lost = table.where(F.col(c).isNotNull() & (F.col(c) != "")).join(other.select(F.col(column).alias("ref")), F.col(c) == F.col("ref"), "left_anti")
        parts.append(lost.select(F.lit(f"{c} has no {column}").alias("rule"), F.col(c).cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(name).alias("table"), "rule", "value")


def listing(table: DataFrame, order: list[str], form: str = "table") -> str:
    """A catalog table as aligned text, names alone, or CSV."""
    rows = [r.asDict() for r in table.orderBy(*order).collect()]
    if form == "names":
        return "\n".join(str(r[order[0]]) for r in rows)
    cells = [list(table.columns)] + [["" if v is None else str(v) for v in r.values()] for r in rows]
    if form == "csv":
        return "\n".join(",".join(c) for c in cells)
    width = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells)


def markdown(table: DataFrame, order: list[str]) -> str:
    """A catalog table as a Markdown document part."""
    head, *rows = [r.split("\x1f") for r in ["\x1f".join(table.columns), *("\x1f".join("" if v is None else str(v) for v in r) for r in table.orderBy(*order).collect())]]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["-"] * len(head), *rows])
