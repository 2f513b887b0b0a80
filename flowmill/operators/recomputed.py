"""Roll-ups computed a second time, by other means, and held against published ones.

Sums are free of rounding until their last step: a double is a whole number times a power of two, so within bins of
eight exponents terms add up as integers, in any order and over any number of tasks; the few bins of a sum are added
last. What a rule should give follows from these sums. A published value may be off by the rounding of a plain sum of
its terms, 8 gamma_k of their sizes, and by 64 units of rounding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.operators.rollup import WORLD
from flowmill.operators.validation import EPS, gamma
from flowmill.plans.registry import Rules

BIN = 8


def exact_sums(terms: DataFrame, keys: list[str], x: str = "x", size: str = "size") -> DataFrame:
    """``(*keys, s, size, k)``: sum of ``x``, sum of ``size`` and number of terms, for terms of normal size."""
    # 53 places, not 52: an exponent that log2 rounds up into the next bin still leaves whole numbers.
    e = F.when(F.col(x) == 0, 0).otherwise(BIN * F.floor(F.log2(F.abs(F.col(x))) / BIN)).cast("int")
    rows = terms.withColumn("e", e).withColumn("m", (F.col(x) * F.pow(F.lit(2.0), 53 - F.col("e"))).cast("long").cast("decimal(38,0)"))
    bins = rows.groupBy(*keys, "e").agg(F.sum("m").alias("m"), F.sum(size).alias("size"), F.count("*").alias("k"))
    return bins.groupBy(*keys).agg(F.sum(F.col("m").cast("double") * F.pow(F.lit(2.0), F.col("e") - 53)).alias("s"), F.sum("size").alias("size"), F.sum("k").alias("k"))


def _terms(df: DataFrame, keys: list[str], specs: dict, sized: bool) -> DataFrame:
    """(keys, indicator, part, x, size): the terms of every direct rule; pairs count only where both are there."""
    size = lambda c: F.col(f"{c}__size") if sized else F.abs(F.col(c))
    rows = []

    def add(name, part, value, weight):
        rows.append(F.struct(F.lit(name).alias("indicator"), F.lit(part).alias("part"), value.cast("double").alias("x"), weight.cast("double").alias("size")))

    for name, spec in specs.items():
        ops = [F.col(c) for c in spec.operands]
        if spec.strategy == "weighted_mean":
            both = ops[0].isNotNull() & ops[1].isNotNull()
            add(name, "top", F.when(both, ops[0] * ops[1]), size(spec.value) * F.abs(ops[1]))
            add(name, "bottom", F.when(both, ops[1]), size(spec.weight))
        elif spec.strategy == "ratio_of_sums":
            both = ops[0].isNotNull() & ops[1].isNotNull()
            add(name, "top", F.when(both, ops[0]), size(spec.numerator))
            add(name, "bottom", F.when(both, ops[1]), size(spec.denominator))
        elif spec.strategy != "not_applicable":
            add(name, "top", ops[0], size(spec.value))
    got = df.select(*keys, F.explode(F.array(*rows)).alias("t")).select(*keys, "t.*")
    return got.where(F.col("x").isNotNull())


def level(df: DataFrame, keys: list[str], specs: dict, formulas: dict, sized: bool = False) -> DataFrame:
    """Wide table of what the rules give: for each indicator its value, ``__size`` (of the bound) and ``__k``."""
    terms = _terms(df, keys, specs, sized)
    sums = exact_sums(terms, [*keys, "indicator", "part"])
    ends = terms.groupBy(*keys, "indicator").agg(F.min("x").alias("low"))
    side = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    one = sums.groupBy(*keys, "indicator").agg(*(side(p, c).alias(f"{p}_{c}") for p in ("top", "bottom") for c in ("s", "size", "k"))).join(ends, [*keys, "indicator"])
    top, bottom = F.col("top_s"), F.col("bottom_s")
    rows = df.select(*keys).distinct()
    values = {
        "sum": (top, F.col("top_size")), "mean": (top / F.col("top_k"), F.col("top_size") / F.col("top_k")), "invariant": (F.col("low"), F.abs("low")),
        "ratio": (F.try_divide(top, bottom), F.try_divide(F.col("top_size") + F.abs(F.try_divide(top, bottom)) * F.col("bottom_size"), F.abs(bottom))),
    }
    kind = {"weighted_mean": "ratio", "ratio_of_sums": "ratio"}
    pick = lambda i, c: F.max(F.when(F.col("indicator") == i, c))
    columns = []
    for i, spec in specs.items():
        v, size = values.get(kind.get(spec.strategy, spec.strategy), (F.lit(None).cast("double"), F.lit(0.0)))
        columns += [pick(i, v).alias(i), pick(i, size).alias(f"{i}__size"), pick(i, F.col("top_k") + F.coalesce("bottom_k", F.lit(0))).alias(f"{i}__k")]
    wide = rows.join(one.groupBy(*keys).agg(*columns), keys, "left")
    for i, f in formulas.items():
        a, b = f.needs
        value = f.make()
        wide = wide.withColumns({i: value, f"{i}__size": F.try_divide(F.col(f"{a}__size") + F.abs(F.try_divide(F.col(a), F.col(b))) * F.col(f"{b}__size"), F.abs(F.col(b))), f"{i}__k": F.col(f"{a}__k") + F.col(f"{b}__k")})
    return wide


def compared(wanted: DataFrame, published: DataFrame, keys: list[str], check_id: str, specs: dict, names: list[str]) -> DataFrame:
    """(check_id, scope, difference, scale, tolerance) of every cell; a value on one side alone is infinitely off."""
    got = published.select(*keys, *(F.col(i).cast("double").alias(f"{i}__got") for i in names))
    both = wanted.join(got, keys, "full")
    cells = []
    for i in names:
        want, have, k = F.col(i), F.col(f"{i}__got"), F.coalesce(f"{i}__k", F.lit(1)).cast("double")
        bound = 64 * EPS * F.greatest(F.lit(1.0), F.abs(want)) + 8 * gamma(k + 1) * F.coalesce(f"{i}__size", F.lit(0.0))
        if i in specs and specs[i].strategy == "invariant":
            bound = bound + specs[i].tolerance * F.greatest(F.lit(1.0), F.abs(want))
        off = F.when(want.isNull() & have.isNull(), 0.0).otherwise(F.coalesce(F.abs(want - have), F.lit(float("inf"))))
        cells.append(F.struct(F.lit(i).alias("scope"), off.alias("difference"), want.alias("scale"), F.coalesce(bound, F.lit(0.0)).alias("tolerance")))
    return both.select(F.lit(check_id).alias("check_id"), F.explode(F.array(*cells)).alias("c")).select("check_id", "c.*")


def recomputed_all(sectors: DataFrame, published: DataFrame, rules: Rules) -> DataFrame:
    """Ledger rows for every indicator of the registry at both levels: countries from sectors, the world from the
    recomputed countries. ``published``: (year, country or WWW, indicators)."""
    formulas, names = rules.formulas, list(rules.bindings)
    low = {i: b.sector for i, b in rules.direct.items()}
    high = {i: b.country for i, b in rules.direct.items()}
    countries = level(sectors, ["year", "country"], low, formulas)
    world = level(countries, ["year"], high, formulas, sized=True)
    cells = compared(countries, published.where(F.col("country") != WORLD), ["year", "country"], "recomputed_country", low, names)
    cells = cells.unionByName(compared(world, published.where(F.col("country") == WORLD).drop("country"), ["year"], "recomputed_world", high, names))
    return summarised(cells)


def summarised(cells: DataFrame) -> DataFrame:
    """Ledger rows by (check_id, scope) from cells with difference, scale and tolerance."""
    d, t = F.col("difference"), F.col("tolerance")
    return cells.groupBy("check_id", "scope").agg(
        F.count("*").alias("n"), F.max(d).alias("max_abs"), F.max(d / F.greatest(F.lit(1.0), F.abs(F.coalesce("scale", F.lit(0.0))))).alias("max_scaled"), F.max(t).alias("tolerance"), F.when(F.bool_or(d > t), "failed").otherwise("passed").alias("status")
    )


def in_profile(sectors: DataFrame, profile: list[dict], pinned: DataFrame | None = None, keys: tuple[str, ...] = ("year", "country", "sector")) -> DataFrame:
    """Ledger rows of range rules in one aggregation. ``profile``: rows of indicator, low, high (None: unbounded) and zero
    (exactly 0 everywhere). ``pinned``: (keys, indicator, sign) of cells that may break their range with that sign;
    one that doesn't is a breach too, so a list can't outlive its cells."""
    cells = []
    for r in profile:
        v = F.col(r["indicator"]).cast("double")
        low, high = (F.lit(float(x)) if x is not None else None for x in (r.get("low"), r.get("high")))
        off = F.abs(v) if r.get("zero") else reduce(F.greatest, [x for x in (low - v if low is not None else None, v - high if high is not None else None) if x is not None], F.lit(0.0))
        cells.append(F.struct(F.lit(r["indicator"]).alias("scope"), v.alias("v"), F.when(v.isNull() | F.isnan(v), float("inf") if not r.get("missing") else 0.0).otherwise(off).alias("off")))
    rows = sectors.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    sign: Column = F.lit(None).cast("int")
    if pinned is not None:
        rows = rows.join(pinned.select(*keys, F.col("indicator").alias("scope"), F.col("sign").cast("int").alias("sign")), [*keys, "scope"], "left")
        sign = F.col("sign")
    excused = sign.isNotNull() & (F.col("off") > 0) & (F.signum("v") == sign)
    stale = sign.isNotNull() & ~excused
    difference = F.when(excused, 0.0).when(stale, F.greatest(F.col("off"), F.lit(1.0))).otherwise(F.col("off"))
    return summarised(rows.select(F.lit("range").alias("check_id"), "scope", difference.alias("difference"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("tolerance")))


#: What every method's results must keep to, and what single options add (fixed values).
NEVER_NEGATIVE = ("go_us", "gdp_us", "emp", "hours_emp", "comp_emp", "abstract_emp_mv", "gdp_mv", "gdp_p_us", "go_mv", "lfv_emp", "value_m_mv", "exports_us", "exports_mv", "imports_us", "imports_mv", "gdp_du", "go_du")


def profile_of(depreciation: str = "capital", more: tuple[dict, ...] = ()) -> list[dict]:
    """The range rules of a method: amounts are not negative, and depreciation is 0 where the method has none."""
    rows = [{"indicator": n, "low": 0.0} for n in NEVER_NEGATIVE]
    return [*rows, *({"indicator": "depreciation_us", "zero": True} for _ in range(depreciation == "zero")), *more]


def depreciation_sums(depreciation: DataFrame, composition: DataFrame, rates: DataFrame) -> DataFrame:
    """Ledger row: by year, destination and type, depreciation over origins equals capital over origins times the rate.
    ``depreciation``, ``composition``: (year, origin, destination, ktype, value); ``rates``: (year, d_sector, ktype, rate)."""
    keys = ["year", "d_country", "d_sector", "ktype"]
    have = depreciation.groupBy(*keys).agg(F.sum("value").alias("have"), F.sum(F.abs("value")).alias("size"), F.count("*").alias("k"))
    want = composition.groupBy(*keys).agg(F.sum("value").alias("capital")).join(rates, ["year", "d_sector", "ktype"], "left")
    both = want.join(have, keys, "full").withColumn("want", F.col("capital") * F.col("rate"))
    off = F.coalesce(F.abs(F.col("want") - F.col("have")), F.lit(float("inf")))
    bound = 64 * EPS * F.greatest(F.lit(1.0), F.abs("want")) + 8 * gamma(2 * F.col("k").cast("double") + 2) * F.col("size")
    return summarised(both.select(F.lit("depreciation_sums").alias("check_id"), F.lit("destination").alias("scope"), off.alias("difference"), F.col("want").alias("scale"), F.coalesce(bound, F.lit(0.0)).alias("tolerance")))
