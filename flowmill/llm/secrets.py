"""Operator 6: secret scans by a trigram inverted index (DataFrame functions only).

From each rule's regex a Boolean trigram query is derived: literal runs give conjunctions,
alternatives give disjunctions, anything without a fixed text gives nothing. The index holds
postings (trigram, document) for the trigrams of the rules over lower-cased text; intersecting
postings gives each document's candidate rules, which are then verified on its whole text. Rules
without a mandatory trigram scan every text.

Spans come from one expression per rule: the regex is matched behind the lazily taken text since the
previous match, so gap and match lengths add up to code point offsets.

Texts are shuffled once, to meet their candidate rules by document id; postings are a few bytes.

Defined cases: null text is empty and has no span; long texts are searched whole; a null id is matched like any other; rows with
one id share their candidates (a superset) and are verified on their own text; an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import fresh_name


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the least length of ``group`` (0: the match); shorter ones drop."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0


#: The base rules, in the order by which equal starts are listed (fixed values).
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # runs of 20 characters or more
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Further public token formats.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]{20,}", True),
    Rule("login", r"[a-z]{2,10}://[^/\s:@]{1,64}:[^/\s:@]{1,64}@", True),
]
RULES = BASE + MORE
MOST_TEXTS = 64


def _exact(item) -> set[str] | None:
    """All texts that a part of a parsed regex can match, in lower case; None if not a small set."""
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        if all(str(o) == "LITERAL" for o, _ in arg):
            return {chr(c).lower() for _, c in arg}
        return None
    if op == "SUBPATTERN":
        return _exact_run(arg[-1])
    if op == "BRANCH":
        sets = [_exact_run(b) for b in arg[1]]
        return None if any(s is None for s in sets) else set().union(*sets)
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        texts = _exact_run(inner)
        if texts is None or high > 8:
            return None
        out: set[str] = set()
        for n in range(low, high + 1):
            if len(texts) ** n > MOST_TEXTS:
                return None
            out |= {"".join(p) for p in product(sorted(texts), repeat=n)}
        return out if len(out) <= MOST_TEXTS else None
    return None


def _exact_run(items) -> set[str] | None:
    out = {""}
    for item in items:
        texts = _exact(item)
        if texts is None or len(out) * len(texts) > MOST_TEXTS:
            return None
        out = {a + b for a in out for b in texts}
    return out


def _clause(texts: set[str]) -> list[frozenset[str]] | None:
    """The disjunction 'one of these texts occurs', as trigram conjunctions; None if it says nothing."""
    options = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts}
    if frozenset() in options:
        return None
    return sorted((o for o in options if not any(p < o for p in options)), key=sorted)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets that every match's text satisfies; empty if
    the pattern has no mandatory trigram."""
    return _query(re._parser.parse(pattern))


def _query(items) -> list[list[frozenset[str]]]:
    clauses, run = [], {""}

    def close():
        nonlocal run
        clause = _clause(run)
        if clause is not None:
            clauses.append(clause)
        run = {""}

    for item in items:
        texts = _exact(item)
        if texts is not None and len(run) * len(texts) <= MOST_TEXTS:
            run = {a + b for a in run for b in texts}
            continue
        close()
        op, arg = str(item[0]), item[1]
        if texts is not None:
            run = texts
        elif op == "SUBPATTERN":
            clauses += _query(arg[-1])
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            clauses += _query(arg[2])
        elif op == "BRANCH":
            each = [_query(b) for b in arg[1]]
            if all(each):  # one clause of each branch will do
                clauses.append([o for q in each for o in min(q, key=len)])
    close()
    return clauses


def vocabulary(rules: list[Rule]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for option in clause for t in option})


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, doc_id) of the given lower-case trigrams."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("low")).where(F.col("low").isNotNull())
    hits = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t)) if trigrams else F.array().cast("array<string>")
    return rows.select(F.explode(hits).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rules): the kinds whose trigram query the document's postings satisfy."""
    words = vocabulary(rules)
    place = {t: k for k, t in enumerate(words)}
    n = len(words) // 63 + 1
    number = F.element_at(F.create_map(*(F.lit(x) for t, k in place.items() for x in (t, k))), F.col("trigram")) if words else F.lit(0)
    postings = index.select("doc_id", number.alias("k"))
    sets = postings.groupBy("doc_id").agg(*[F.bit_or(F.when(F.floor(F.col("k") / 63) == i, F.expr(f"shiftleft(1L, k - {63 * i})")).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(n)])

    def has(option: frozenset[str]) -> Column:
        need = [0] * n
        for t in option:
            need[place[t] // 63] |= 1 << place[t] % 63
        return reduce(Column.__and__, [F.col(f"m{i}").bitwiseAND(F.lit(v).cast("long")) == F.lit(v).cast("long") for i, v in enumerate(need) if v])

    kinds = []
    for r in rules:
        query = trigram_query(r.pattern)
        if query:
            test = reduce(Column.__and__, [reduce(Column.__or__, map(has, clause)) for clause in query])
            kinds.append(F.when(test, F.lit(r.kind)))
    found = F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>")
    return sets.select("doc_id", found.alias("rules")).where(F.size("rules") > 0)


def spans_of(rule: Rule, order: int, text: Column, wanted: Column) -> Column:
    """array<struct<start, order, end, kind>> of a rule's matches where ``wanted`` holds."""
    core = f"(?i:{rule.pattern})" if rule.ignore_case else f"(?:{rule.pattern})"
    anchored = F.lit(rf"\G([\s\S]*?)({core})")
    pairs = F.arrays_zip(F.regexp_extract_all(text, anchored, F.lit(1)).alias("gap"), F.regexp_extract_all(text, anchored, F.lit(2)).alias("hit"))
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"

    def step(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        size = F.length(F.regexp_extract(pair["hit"], core, rule.group)) if rule.group else end - start
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))).cast(kind)
        return F.struct(end.alias("at"), F.when(size >= rule.least, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.when(wanted & text.rlike(core), F.aggregate(pairs, first, step)["out"]).otherwise(F.array().cast(kind))


def with_secrets(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` and an array ``out`` of spans by start, then by the order of the rules."""
    key, kinds = fresh_name(docs, "doc_key"), fresh_name(docs, "doc_rules")
    found = candidates(trigram_index(docs, vocabulary(rules), id_col, text_col), rules).select(F.col("doc_id").alias(key), F.col("rules").alias(kinds))
    rows = docs.join(found, docs[id_col].eqNullSafe(found[key]), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = []
    for order, rule in enumerate(rules):
        wanted = F.coalesce(F.array_contains(F.col(kinds), rule.kind), F.lit(False)) if trigram_query(rule.pattern) else F.lit(True)
        each.append(spans_of(rule, order, text, wanted))
    return rows.withColumn(out, F.array_sort(F.concat(*each))).select(*(c for c in docs.columns if c != out), out)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of spans of each base kind, a digest of the base spans and all spans."""
    rows = with_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["order"] < len(BASE))

    def of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(r.kind) for r in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
