"""Operator 2: mixing sources to target weights by iterative proportional fitting (DataFrame
functions only).

Documents are pre-aggregated to cells (source, language, topic) of token weights. Raking scales the
cells' weights to each marginal's target shares in turn, for a number of rounds. A document's
probability is ``share`` times its cell's ratio of raked to present tokens, and a hash of its id
decides, so the sample is the same on any cluster.

A ratio may exceed 1. The bound is therefore part of the raking: what a cell can't hold is raked over
the other cells of its labels, and ``share`` is lowered as far as the targets need it, since a label
can't give more tokens than it has. ``deviations`` reports target and expected shares of each label.
(Without ``bounded`` ratios are cut at 1, and the sample misses the targets.)

Only cells are shuffled more than once. Raking runs on the cell table, in windows by one label each;
its size is the product of label counts, not of documents. It is joined to the documents by broadcast
if it has at most ``broadcast_cells`` cells, and by a shuffle join beyond that.

Defined cases: null labels are the label "unknown"; null text has no token; a cell without tokens
keeps weight 0 and its documents probability 0; targets for absent labels are shared out among the
present ones; labels without a target get share 0; a null id hashes as the empty string; repeated
rows are decided alike; long texts count whole; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowmill.llm.common import fresh_name, saved

UNKNOWN = "unknown"
MARGINS = ("source", "lang", "topic")
#: Powers of the present shares that give the default targets.
POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.7}


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sign_count(text: Column) -> Column:
    """Signs: neither letters, digits nor white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")), F.lit(0))


def line_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("\n")), F.lit(0)) + 1


def style(words: Column, signs: Column, lines: Column) -> Column:
    """A topic from the text's style, for corpora without topic labels: how many signs come on a word,
    and how many words on a line."""
    density = F.when(signs / words < 0.05, "bare").when(signs / words < 0.5, "plain").when(signs / words < 1.5, "marked").otherwise("dense")
    width = F.when(words < 8 * lines, "short").when(words < 60 * lines, "middle").otherwise("long")
    return F.when(words > 0, F.concat_ws(" ", density, width)).otherwise("empty")


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a marginal's labels: present token shares to a power, normalised."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    return sums.select(margin, F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("target"))


def attainable_targets(targets: DataFrame, cells: DataFrame, margin: str, share: float) -> DataFrame:
    """``targets`` where no label is asked for more than it holds: at most its tokens over ``share`` of all tokens. What such
    labels can't give is shared out among the others in proportion to their targets."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    rows = sums.join(targets, margin).where("target > 0")
    whole = W.partitionBy()  # a row a label
    rows = rows.withColumns({"part": F.col("target") / F.sum("target").over(whole), "cap": F.col("tokens") / F.sum("tokens").over(whole) / F.lit(share)})
    # labels reach their caps in this order; the factor of the rest is the largest of those by number of labels at their caps
    order = W.partitionBy().orderBy(F.col("cap") / F.col("part"), margin)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("part").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("factor", (1 - before) / free)
    return rows.select(margin, F.least("cap", F.col("part") * F.max("factor").over(whole)).alias("target"))


def cells_of(rows: DataFrame, margins=MARGINS, tokens: str = "n_tokens") -> DataFrame:
    return rows.groupBy(*margins).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12, write_every: int = 4) -> DataFrame:
    """``cells`` with ``weight``: tokens scaled to the target shares of each marginal in turn.

    ``targets``: marginal to (label, target), of any positive sum. Lineage is cut every
    ``write_every`` rounds.
    """
    rows = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        rows = rows.join(target.select(F.col(margin), F.col("target").alias(f"goal_{margin}")), margin, "left").withColumn(f"goal_{margin}", F.coalesce(f"goal_{margin}", F.lit(0.0)))
    total = cells.agg(F.sum("tokens").cast("double").alias("t")).first().t or 0.0
    # each marginal's goals, over the labels that are present, sum to all tokens
    for margin in targets:
        present = rows.where("tokens > 0").select(margin, f"goal_{margin}").distinct().agg(F.sum(f"goal_{margin}").alias("s")).first().s or 0.0
        rows = rows.withColumn(f"goal_{margin}", F.col(f"goal_{margin}") * F.lit(total / present if present else 0.0))
    for k in range(rounds):
        for margin in targets:
            held = F.sum("weight").over(W.partitionBy(margin))
            rows = rows.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"goal_{margin}") / held).otherwise(F.lit(0.0)))
        if (k + 1) % write_every == 0:
            rows = saved(rows, "raking")
    return rows.drop(*(f"goal_{m}" for m in targets))


def rake_bounded(raked: DataFrame, share: float, margins=MARGINS, rounds: int = 12, write_every: int = 4, tolerance: float = 1e-3, step: float = 0.95) -> DataFrame:
    """``raked`` cells with ``expected``: tokens of the sample, at most those present, whose marginals
    are in proportion to those of ``weight``.

    The sample is ``share`` of all tokens or, by factors of ``step``, the largest part at which every
    label's expected tokens come within ``tolerance`` of its goal; all parts are raked side by side.
    The smallest is that at which no ratio exceeds 1, where ``weight`` itself is in proportion.
    """
    ratio = raked.where("weight > 0").agg(F.min(F.col("tokens") / F.col("weight")).alias("r")).first().r
    if ratio is None:
        return raked.withColumn("expected", F.lit(0.0))
    tops = [raked.groupBy(m).agg((F.sum("tokens") / F.sum("weight")).alias("r"), F.sum("weight").alias("w")).where("w > 0").agg(F.min("r").alias("r")).first().r for m in margins]
    top = min(share, *tops)
    if top <= ratio:
        return raked.withColumn("expected", F.col("weight") * F.lit(top))
    parts = [max(top * step**k, ratio) for k in range(math.ceil(math.log(top / ratio) / -math.log(step)) + 1)]
    rows = raked.select("*", F.posexplode(F.lit(parts)).alias("try", "expected")).withColumn("expected", F.col("expected") * F.col("weight"))
    for m in margins:
        rows = rows.withColumn(f"goal_{m}", F.sum("expected").over(W.partitionBy("try", m)))
    for k in range(rounds):
        for m in margins:
            # cells reach their bound in this order; the factor that gives the goal is the largest of those by number of cells at the bound
            order = W.partitionBy("try", m).orderBy(F.when(F.col("expected") > 0, F.col("tokens") / F.col("expected")).otherwise(F.lit(float("inf"))), *margins)
            before = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            free = F.sum("expected").over(order.rowsBetween(0, W.unboundedFollowing))
            rows = rows.withColumn("factor", F.when(free > 0, (F.col(f"goal_{m}") - before) / free))
            rows = rows.withColumn("expected", F.col("expected") * F.coalesce(F.max("factor").over(W.partitionBy("try", m)), F.lit(0.0))).drop("factor")
        if (k + 1) % write_every == 0:
            rows = saved(rows, "raking")
    rows = saved(rows.withColumn("expected", F.least("expected", F.col("tokens").cast("double"))), "bounded")
    missed = None
    for m in margins:
        off = rows.groupBy("try", m).agg((F.sum("expected") / F.first(f"goal_{m}")).alias("r"), F.first(f"goal_{m}").alias("g")).where((F.col("g") > 0) & (F.abs(F.col("r") - 1) > tolerance)).select("try")
        missed = off if missed is None else missed.unionByName(off)
    best = min(set(range(len(parts))) - {r["try"] for r in missed.distinct().collect()}, default=len(parts) - 1)  # a number for each part at most
    return rows.where(F.col("try") == best).drop("try", *(f"goal_{m}" for m in margins))


def deviations(cells: DataFrame, margins=MARGINS) -> DataFrame:
    """(margin, label, target, expected): shares of ``weight`` and of ``expected`` by label."""
    total = cells.agg(F.sum("weight").alias("w"), F.sum("expected").alias("e")).first()
    out = None
    for m in margins:
        part = cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("label")).agg((F.sum("weight") / F.lit(total.w or 1.0)).alias("target"), (F.sum("expected") / F.lit(total.e or 1.0)).alias("expected"))
        out = part if out is None else out.unionByName(part)
    return out


def uniform(id_: Column) -> Column:
    """A number in [0, 1) from a hash of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def calibrated(cells: DataFrame, share: float, rounds: int = 12, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, bounded: bool = True) -> DataFrame:
    """``cells`` with ``weight`` and ``expected`` tokens. Targets are ``targets`` (tables of label and
    target, named as the marginals) or else the present shares tempered by ``powers``, those of topics as far as they
    are attainable at ``share``."""
    powers = powers or POWERS
    if targets is None:
        targets = {m: tempered_targets(cells, m, powers[m]) for m in MARGINS}
        targets["topic"] = attainable_targets(targets["topic"], cells, "topic", share)
    raked = rake(cells, targets, rounds)
    return rake_bounded(saved(raked, "raked"), share, MARGINS, rounds) if bounded else raked.withColumn("expected", F.lit(share) * F.col("weight"))


def with_probabilities(docs: DataFrame, share: float = 0.5, rounds: int = 12, powers: dict[str, float] | None = None, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                       source_col: str = "source", lang_col: str = "lang", out: str = "mix", broadcast_cells: int = 100_000, targets: dict[str, DataFrame] | None = None, bounded: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``docs`` and a struct ``out``: source, lang, topic, n_tokens, probability, sampled.

    ``topic``: a column, ``style`` of the text if there is none. ``keep``: columns to return (the id among
    them) if not all; with it texts are counted once and the counts are written, else they are counted
    for the cells and again for the rows. For the rest see ``calibrated``.
    """
    prefix = "cell_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    kept = docs.columns if keep is None else keep
    name = fresh_name(docs.select(*kept), out)
    text = F.col(text_col)
    rows = docs.select(
        *kept, F.coalesce(F.col(source_col), F.lit(UNKNOWN)).alias(f"{prefix}_source"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias(f"{prefix}_lang"), token_count(text).alias(f"{prefix}_n"),
        *([sign_count(text).alias(f"{prefix}_signs"), line_count(text).alias(f"{prefix}_lines")] if topic is None else [F.coalesce(topic, F.lit(UNKNOWN)).alias(f"{prefix}_topic")]),
    )
    if topic is None:  # from columns, so that each is counted once
        rows = rows.withColumn(f"{prefix}_topic", style(*(F.col(f"{prefix}_{c}") for c in ("n", "signs", "lines")))).drop(f"{prefix}_signs", f"{prefix}_lines")
    if keep is not None:
        rows = saved(rows, "counts")
    cells = saved(cells_of(rows.select(*(F.col(f"{prefix}_{m}").alias(m) for m in MARGINS), F.col(f"{prefix}_n").alias("n_tokens"))), "cells")
    raked = calibrated(cells, share, rounds, powers, targets, bounded)
    odds = saved(raked.select(*(F.col(m).alias(prefix + m) for m in MARGINS), F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("expected") / F.col("tokens"))).otherwise(F.lit(0.0)).alias(prefix + "p")), "odds")
    small = odds.count() <= broadcast_cells
    rows = rows.join(F.broadcast(odds) if small else odds, [F.col(f"{prefix}_{m}") == F.col(prefix + m) for m in MARGINS])
    p = F.col(prefix + "p")
    parts = [F.col(f"{prefix}_{m}").alias(m) for m in MARGINS]
    return rows.select(*kept, F.struct(*parts, F.col(f"{prefix}_n").alias("n_tokens"), p.alias("probability"), (uniform(F.col(id_col)) < p).alias("sampled")).alias(name))


def mixed(docs: DataFrame, out: str = "mix", **options) -> DataFrame:
    """The sampled documents."""
    name = fresh_name(docs, out)
    return with_probabilities(docs, out=out, **options).where(F.col(f"{name}.sampled")).select(*docs.columns)


def oracle(share: float = 0.5, rounds: int = 12, tolerance: float = 1e-3, step: float = 0.95) -> str:
    """The same as DuckDB SQL: the rounds are written out as common table expressions."""
    sql = [
        """counts as (select doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as n_tokens,
  len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\x20\\x09-\\x0D]')) as signs, len(regexp_extract_all(text, chr(10))) + 1 as lines from documents)""",
        """facts as (select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, n_tokens, case when n_tokens > 0 then
  case when signs / n_tokens < 0.05 then 'bare' when signs / n_tokens < 0.5 then 'plain' when signs / n_tokens < 1.5 then 'marked' else 'dense' end
  || ' ' || case when n_tokens < 8 * lines then 'short' when n_tokens < 60 * lines then 'middle' else 'long' end else 'empty' end as topic from counts)""",
        "cells as (select source, lang, topic, sum(n_tokens)::double as tokens from facts group by all)",
    ]
    for m in MARGINS:
        sql.append(f"g_{m} as (select {m}, pow(t, {POWERS[m]}) * (select sum(tokens) from cells) / sum(pow(t, {POWERS[m]})) over () as goal from (select {m}, sum(tokens) as t from cells group by {m}) where t > 0)")
    sql.append(f"""c_topic as (select t.topic, goal / sum(goal) over () as part, tokens / sum(tokens) over () / {share} as cap from (select topic, sum(tokens) as tokens from cells group by topic) t join g_topic g on g.topic = t.topic),
l_topic as (select *, (1 - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0)) / sum(part) over (w rows between current row and unbounded following) as factor from c_topic window w as (order by cap / part, topic)),
h_topic as (select topic, least(cap, part * (select max(factor) from l_topic)) * (select sum(tokens) from cells) as goal from l_topic)""")
    named = {m: f"{'h' if m == 'topic' else 'g'}_{m}" for m in MARGINS}
    sql.append("r0 as (select *, tokens as weight from cells)")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            sql.append(f"r{n + 1} as materialized (select source, lang, topic, tokens, case when h > 0 then weight * goal / h else 0 end as weight from (select r.*, coalesce(g.goal, 0) as goal, sum(weight) over (partition by r.{m}) as h from r{n} r left join {named[m]} g on g.{m} = r.{m}))")
            n += 1
    tops = ", ".join(f"(select min(t / w) from (select sum(tokens) as t, sum(weight) as w from r{n} group by {m}) where w > 0)" for m in MARGINS)
    goals = ", ".join(f"goal_{m}" for m in MARGINS)
    sql.append(f"ends as (select (select min(tokens / weight) from r{n} where weight > 0) as low, least({share}, {tops}) as high)")
    sql.append(f"parts as (select k as try, case when high <= low then high else greatest(high * pow({step}, k), low) end as part from ends, range(0, 2000) t(k) where k = 0 or high > low and k <= ceil(ln(high / low) / -ln({step})))")
    sql.append(f"b0 as materialized (select *, {', '.join(f'sum(expected) over (partition by try, {m}) as goal_{m}' for m in MARGINS)} from (select r.*, try, weight * part as expected from r{n} r, parts))")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            sql.append(f"""b{n + 1} as materialized (select source, lang, topic, tokens, try, {goals}, expected * coalesce(max(factor) over (partition by try, {m}), 0) as expected from (
  select *, case when free > 0 then (goal_{m} - before) / free end as factor from (select *, coalesce(sum(tokens) over (w rows between unbounded preceding and 1 preceding), 0) as before,
  sum(expected) over (w rows between current row and unbounded following) as free from b{n}
  window w as (partition by try, {m} order by case when expected > 0 then tokens / expected else 'infinity'::double end, source, lang, topic))))""")
            n += 1
    sql.append(f"bounded as materialized (select * replace (least(expected, tokens) as expected) from b{n})")
    missed = " union all ".join(f"select try from (select try, sum(expected) / first(goal_{m}) as r, first(goal_{m}) as g from bounded group by try, {m}) where g > 0 and abs(r - 1) > {tolerance}" for m in MARGINS)
    sql.append(f"best as (select coalesce((select min(try) from parts where try not in ({missed})), (select max(try) from parts)) as try)")
    sql.append("odds as (select *, case when tokens > 0 then least(1.0, expected / tokens) else 0 end as p from bounded where try = (select try from best))")
    return "with " + ",\n".join(sql) + """
select doc_id, facts.source, facts.lang, facts.topic, n_tokens::bigint as n_tokens, round(p, 6) as probability,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 < p as sampled
from facts join odds on odds.source = facts.source and odds.lang = facts.lang and odds.topic = facts.topic"""
