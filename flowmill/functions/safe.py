"""Missing-value states, special-value checks and division policies.

A measured cell is a value column and a state column; NULL values always carry a state other than
``finite``. NaN and infinities are never legal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cell states, strongest last (fixed values).
STATES = ("finite", "not_applicable", "source_missing", "uncomputed")
#: Division policies (fixed values).
POLICIES = ("error", "zero_if_both_zero", "not_applicable", "not_applicable_if_both_zero", "zero_if_denominator_zero")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_special(x) -> Column:
    """NaN or infinite."""
    x = _c(x)
    return x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf")))


def special_cells(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Rows (keys, indicator, value) of NaN or infinite cells; must be empty."""
    long = df.unpivot(keys, values, "indicator", "value")
    return long.where(is_special("value"))


def classify(value, allowed_missing, missing_state: str = "source_missing") -> Column:
    """State of a cell: special values and undeclared NULLs abort the query."""
    v = _c(value)
    return (
        F.when(is_special(v), F.raise_error(F.lit("NaN or infinite value")))
        .when(v.isNotNull(), "finite")
        .when(_c(allowed_missing), F.lit(missing_state))
        .otherwise(F.raise_error(F.lit("missing value outside the declared mask")))
    )


def state_rank(state) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), _c(state))


def merged_state(*states) -> Column:
    """The strongest of several states: uncomputed > source_missing > not_applicable > finite."""
    top = F.greatest(*(F.coalesce(state_rank(s), F.lit(1)) for s in states)) if len(states) > 1 else state_rank(states[0])
    return F.element_at(F.array(*map(F.lit, STATES)), top.cast("int"))


def group_state(state) -> Column:
    """Aggregate: the strongest state of a group."""
    return F.element_at(F.array(*map(F.lit, STATES)), F.max(state_rank(state)).cast("int"))


def divide(n, d, policy: str) -> Column:
    """``n / d`` with an explicit rule for zero denominators; NULL operands give NULL."""
    n, d = _c(n), _c(d)
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    both, zero = (n == 0) & (d == 0), d == 0
    null, error = F.lit(None).cast("double"), F.raise_error(F.lit("division by zero")).cast("double")
    at_zero = {
        "error": error, "zero_if_both_zero": F.when(both, 0.0).otherwise(error), "not_applicable": null,
        "not_applicable_if_both_zero": F.when(both, null).otherwise(error), "zero_if_denominator_zero": F.lit(0.0),
    }[policy]
    return F.when(n.isNull() | d.isNull(), null).when(zero, at_zero).otherwise(n / d)


def divide_states(n, d, n_state, d_state, policy: str) -> tuple[Column, Column]:
    """Value and state of a ratio: missing operands pass on their merged state, an inapplicable
    ratio is ``not_applicable`` unless an operand is declared missing."""
    n, d = _c(n), _c(d)
    value = divide(n, d, policy)
    state = F.when(n.isNull() | d.isNull(), merged_state(n_state, d_state)).when(value.isNull(), "not_applicable").otherwise("finite")
    return value, state


def sequential_ratio(x, divisors: list, policy: str = "not_applicable") -> Column:
    """x / d1 / d2 ..., each step by the same policy."""
    return reduce(lambda a, d: divide(a, d, policy), divisors, _c(x))


def aggregate_margin(df: DataFrame, keys: list[str], value: str, operation: str = "sum", missing: str = "available", state: str | None = None) -> DataFrame:
    """Sum or mean over the cells of each key with a group state.

    ``missing``: ``available`` uses what is there (state ``partial`` if some cells lack), ``propagate``
    gives NULL if any cell lacks, ``error`` aborts. A group without any value stays NULL, never 0.
    """
    f = {"sum": F.sum, "mean": F.avg}[operation]
    have, all_ = F.count(value), F.count(F.lit(1))
    held = f(value)
    lacking = group_state(F.coalesce(F.when(F.col(value).isNull(), F.coalesce(F.col(state), F.lit("source_missing")) if state else F.lit("source_missing")), F.lit("finite")))
    out = df.groupBy(*keys).agg(held.alias("v"), have.alias("h"), all_.alias("n"), lacking.alias("s"))
    if missing == "error":
        v = F.when(F.col("h") < F.col("n"), F.raise_error(F.lit("missing cell")).cast("double")).otherwise(F.col("v"))
    elif missing == "propagate":
        v = F.when(F.col("h") == F.col("n"), F.col("v"))
    else:
        v = F.col("v")
    s = F.when(F.col("h") == F.col("n"), "finite").when((F.col("h") > 0) & F.lit(missing == "available"), "partial").otherwise(F.col("s"))
    return out.select(*keys, v.alias(value), s.alias("state"))


def sparse_states(df: DataFrame, keys: list[str], values: list[str], states: dict[str, str]) -> DataFrame:
    """One row per missing cell: keys, indicator, state (the form in which states are stored)."""
    parts = [df.where(F.col(v).isNull()).select(*keys, F.lit(v).alias("indicator"), F.col(states[v]).alias("state")) for v in values]
    return reduce(DataFrame.unionByName, parts)


def restored_states(df: DataFrame, keys: list[str], values: list[str], sparse: DataFrame) -> DataFrame:
    """State columns ``<indicator>__state`` from the stored sparse form."""
    wide = sparse.groupBy(*keys).pivot("indicator", values).agg(F.first("state"))
    wide = wide.select(*keys, *(F.col(f"`{v}`").alias(f"{v}__state") for v in values))
    out = df.join(wide, keys, "left")
    return out.select(*df.columns, *(F.coalesce(f"{v}__state", F.when(F.col(v).isNotNull(), "finite").otherwise("uncomputed")).alias(f"{v}__state") for v in values))


def declared_states(cells: DataFrame, rules: DataFrame, default: str = "finite") -> DataFrame:
    """Adds ``declared`` by a rule table (indicator, checkpoint, country or NULL for all, state). The
    most specific rule wins; two states at the same level abort."""
    hit = cells.alias("c").join(rules.alias("r"), (F.col("c.indicator") == F.col("r.indicator")) & (F.col("c.checkpoint") == F.col("r.checkpoint")) & (F.col("r.country").isNull() | (F.col("r.country") == F.col("c.country"))), "left")
    keys = [F.col(f"c.{k}") for k in cells.columns]
    special = F.col("r.country").isNotNull() & F.col("r.state").isNotNull()
    out = hit.groupBy(*keys).agg(
        F.collect_set(F.when(special, F.col("r.state"))).alias("own"), F.collect_set(F.when(~special, F.col("r.state"))).alias("general")
    )
    pick = F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("general"))
    clash = F.raise_error(F.lit("conflicting declared states"))
    return out.select(*cells.columns, F.when(F.size(pick) > 1, clash).when(F.size(pick) == 1, pick[0]).otherwise(F.lit(default)).alias("declared"))


def observed_mask_errors(df: DataFrame, value: str, declared: str) -> DataFrame:
    """Cells whose missingness differs from what is declared: the validator of masks."""
    return df.where(F.col(value).isNull() != (F.col(declared) != "finite"))


def anomalies(df: DataFrame, keys: list[str], values: list[str], declared: Column, context: str, action: str) -> DataFrame:
    """Rows (keys, indicator, problem, context, action) of cells that are NaN, infinite, or missing where
    ``declared`` (a condition on keys and ``indicator``) doesn't allow it."""
    long = df.unpivot(keys, values, "indicator", "value")
    problem = F.when(is_special("value"), "not finite").when(F.col("value").isNull() & ~F.coalesce(declared, F.lit(False)), "missing")
    return long.withColumn("problem", problem).where("problem is not null").select(*keys, "indicator", "problem", F.lit(context).alias("context"), F.lit(action).alias("action"))
