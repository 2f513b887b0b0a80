"""Accounts from satellite tables by declared recipes, rates as of a year, and the reference basket.

A satellite table is long: (keys, variable, value). A recipe names the variables to sum, or earlier
columns, and a scale. All recipes of a source are one grouped sum with partial sums before the
shuffle, so its cost doesn't grow with their number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("year", "country", "sector")
WORLD = "WWW"


@dataclass(frozen=True)
class Recipe:
    """One account: exactly one of ``rows`` (variables by name), ``pattern`` (variables by regular
    expression), ``of`` (a sum of accounts made before it) and ``constant``.

    ``missing``: with "strict" an absent or missing variable makes the account missing, with
    "available" it is left out; an ``available`` sum of nothing is 0.
    """

    name: str
    rows: tuple[str, ...] = ()
    pattern: str | None = None
    of: tuple[str, ...] = ()
    constant: float | None = None
    scale: float = 1.0
    missing: str = "strict"

    @property
    def stage(self) -> int:
        return 0 if self.rows or self.pattern is not None else 1


# Names of the variables in two satellite sources.
SKILLS = ("Low-skilled", "Medium-skilled", "High-skilled")
GENDERS = ("male", "female")
PEOPLE = tuple(f"Employment people: {s} {g}" for s in SKILLS for g in GENDERS)
HOURS = tuple(f"Employment hours: {s} {g}" for s in SKILLS for g in GENDERS)
COMPENSATION = tuple(f"Compensation of employees; wages, salaries, & employers' social contributions: {s}" for s in SKILLS)
TAXES = ("Taxes less subsidies on products purchased: Total", "Other net taxes on production")
NET_SURPLUS = ("Operating surplus: Rents on land", "Operating surplus: Royalties on resources", "Operating surplus: Remaining net operating surplus")
FIXED_CAPITAL = "Operating surplus: Consumption of fixed capital"
JOBS = ("Employment emissions (Gg).Male", "Employment emissions (Gg).Female")
WAGES = "Value added, from wages (000 USD).Total"
VALUE_ADDED = "Value added, Total (000 USD).Total"
DEPRECIATION = "Value added from depreciation (000 USD).Total"
SURPLUS_AND_MIXED = ("Value added from NOS (000 USD).Total", "Value added from NMI (000 USD).Total")

#: Recipes by kind of source: ``by_skill`` has persons, hours and pay by skill, ``by_account`` money in thousands.
RECIPES: dict[str, tuple[Recipe, ...]] = {
    "by_skill": (
        Recipe("emp", PEOPLE, scale=1e3),
        Recipe("hours_emp", HOURS, scale=1e6),
        Recipe("comp_emp", pattern="Compensation ", missing="available"),
        Recipe("gdp_us", (*TAXES, *COMPENSATION, *NET_SURPLUS, FIXED_CAPITAL)),
        Recipe("profit_us", NET_SURPLUS),
        Recipe("depreciation_us", (FIXED_CAPITAL,)),
        Recipe("empe", of=("emp",)),
        Recipe("hours_empe", of=("hours_emp",)),
        Recipe("comp_empe", of=("comp_emp",)),
        Recipe("capital", constant=0.0),
    ),
    "by_account": (
        Recipe("emp", JOBS, scale=1e3),
        Recipe("comp_emp", (WAGES,), scale=1e-3),
        Recipe("gdp_us", (VALUE_ADDED,), scale=1e-3),
        Recipe("profit_us", SURPLUS_AND_MIXED, scale=1e-3),
        Recipe("depreciation_us", (DEPRECIATION,), scale=1e-3),
        Recipe("empe", of=("emp",)),
        Recipe("comp_empe", of=("comp_emp",)),
        Recipe("abstract_labour_emp", of=("emp",)),
        Recipe("abstract_labour_empe", of=("abstract_labour_emp",)),
        Recipe("capital", constant=0.0),
    ),
}
#: The older release of ``by_skill``: value added by patterns, whatever variables there are.
RECIPES["by_skill_3_7"] = tuple(Recipe("gdp_us", pattern="Compensation |surplus:|axes ", missing="available") if r.name == "gdp_us" else r for r in RECIPES["by_skill"])


def recipe_errors(recipes: tuple[Recipe, ...]) -> list[str]:
    """What is wrong with the recipes, before any job."""
    out, known = [], set()
    for r in recipes:
        sources = [bool(r.rows), r.pattern is not None, bool(r.of), r.constant is not None]
        if sum(sources) != 1:
            out.append(f"{r.name}: needs one of rows, pattern, of and constant")
        if len(set(r.rows)) < len(r.rows):
            out.append(f"{r.name}: a variable is named twice")
        if r.missing not in ("strict", "available"):
            out.append(f"{r.name}: unknown treatment of missing values {r.missing!r}")
        if r.pattern is not None and r.missing == "strict":
            out.append(f"{r.name}: a pattern doesn't say which variables have to be there")
        if r.name in known:
            out.append(f"{r.name}: made twice")
        out += [f"{r.name}: {c} isn't made before it" for c in r.of if c not in known]
        known.add(r.name)
    return out


def _chosen(r: Recipe) -> Column:
    return F.col("variable").isin(*r.rows) if r.rows else F.col("variable").rlike(r.pattern)


def accounts_by_recipe(long: DataFrame, recipes: tuple[Recipe, ...], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``long`` (keys, variable, value) to one column an account, a row for every key in the table.

    NaN counts as missing. A variable that a key has twice fails the job in every recipe that names
    it; an empty table gives no rows; variables that no recipe names are ignored.
    """
    if errors := recipe_errors(recipes):
        raise ValueError("; ".join(errors))
    value = F.when(~F.isnan("value"), F.col("value").cast("double"))
    direct = [r for r in recipes if r.stage == 0]
    # Each variable of a key first: partial sums by (key, variable) find repeats whatever a recipe chooses.
    one = long.groupBy(*keys, "variable").agg(F.count("*").alias("n"), F.sum(value).alias("value"))
    used = reduce(Column.__or__, map(_chosen, direct), F.lit(False))
    message = F.concat(F.lit("a variable stands twice: "), F.col("variable"))
    checked = one.withColumn("value", F.when(used & (F.col("n") > 1), F.raise_error(message).cast("double")).otherwise(F.col("value")))

    def total(r: Recipe) -> Column:
        chosen = F.when(_chosen(r), F.col("value"))
        if r.missing == "available":
            return F.coalesce(F.sum(chosen), F.lit(0.0)) * r.scale
        return F.when(F.count(chosen) == len(r.rows), F.sum(chosen)) * r.scale

    out = checked.groupBy(*keys).agg(*(total(r).alias(r.name) for r in direct))
    for r in recipes:
        if r.stage == 1:
            made = F.lit(float(r.constant)) if r.constant is not None else reduce(Column.__add__, map(F.col, r.of))
            out = out.withColumn(r.name, made * r.scale)
    return out.select(*keys, *(r.name for r in recipes))


def as_of(rows: DataFrame, table: DataFrame, keys: list[str], at: str = "year") -> DataFrame:
    """Left join of each row to the last row of ``table`` with its keys at or before its ``at``.

    The window runs over distinct (keys, at) alone, never over ``rows``, so a key that many rows
    share costs no more than its years. Missing keys and rows before the first entry get NULL; a
    key that ``table`` has twice at a time takes the larger entry.
    """
    names = [c for c in table.columns if c not in (*keys, at)]
    entries = table.groupBy(*keys, at).agg(F.max(F.struct(*names)).alias("entry_"))
    wanted = rows.select(*keys, at).distinct()
    both = entries.withColumn("asked_", F.lit(False)).unionByName(wanted.withColumn("asked_", F.lit(True)), allowMissingColumns=True)
    # Entries of a time come before questions about it.
    w = W.partitionBy(*keys).orderBy(at, "asked_").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("entry_", F.last("entry_", ignorenulls=True).over(w)).where("asked_").drop("asked_")
    return rows.join(found, [*keys, at], "left").select(*rows.columns, *(F.col(f"entry_.{n}").alias(n) for n in names))


def rates_in_first_currency(places: DataFrame, rates: DataFrame, successions: DataFrame) -> DataFrame:
    """(country, year, rate): each country's rate in units of its first currency throughout.

    ``places``: (country, year); ``rates``: (currency, year, rate), with gaps; ``successions``:
    (country, year, currency, per_unit): from that year the country uses ``currency``, one unit of
    which replaced ``per_unit`` of its first one. Before any, its currency has the country's name.
    """
    of = as_of(places, successions, ["country"])
    of = of.withColumns({"currency": F.coalesce("currency", "country"), "per_unit": F.coalesce("per_unit", F.lit(1.0))})
    return as_of(of, rates, ["currency"]).select("country", "year", (F.col("rate") * F.col("per_unit")).alias("rate"))


def reference_basket_value(basket: DataFrame, lam: DataFrame, prices: DataFrame, rates: DataFrame, successions: DataFrame, base_year: int) -> DataFrame:
    """(year, country, basket_hours, value): labour in the base year's basket at each year's lambda, and that
    times the base year's exchange rate and the price index over the year's rate.

    ``basket``: (year, o_country, o_sector, d_country, basket); ``prices``: (country, year, cpi). The
    row ``WWW`` has the mean basket of all countries, in labour alone. A year without an index or a
    rate has no value; industries without a lambda are left out.
    """
    fixed = basket.where(F.col("year") == base_year).groupBy("o_country", "o_sector", F.col("d_country").alias("country")).agg(F.sum("basket").alias("basket"))
    n = fixed.agg(F.count_distinct("country").alias("n"))  # a single row
    world = fixed.groupBy("o_country", "o_sector").agg(F.sum("basket").alias("b")).crossJoin(n)
    both = fixed.unionByName(world.select("o_country", "o_sector", F.lit(WORLD).alias("country"), (F.col("b") / F.col("n")).alias("basket")))
    side = lam.select("year", F.col("country").alias("o_country"), F.col("sector").alias("o_sector"), "lam")
    hours = both.join(side, ["o_country", "o_sector"]).groupBy("year", "country").agg(F.sum(F.col("basket") * F.col("lam")).alias("basket_hours"))
    places = hours.select("country", "year")
    base = fixed.select("country").distinct().withColumn("year", F.lit(base_year).cast(dict(places.dtypes)["year"]))
    rate = rates_in_first_currency(places.unionByName(base).distinct(), rates, successions)
    first = rate.where(F.col("year") == base_year).select("country", F.col("rate").alias("first_"))
    priced = hours.join(rate, ["country", "year"], "left").join(first, "country", "left").join(prices.select("country", "year", "cpi"), ["country", "year"], "left")
    return priced.select("year", "country", "basket_hours", F.try_divide(F.col("basket_hours") * F.col("first_") * F.col("cpi"), F.col("rate")).alias("value"))
