"""Operator 10: linking tool calls in chats (DataFrame functions only).

Messages give calls (assistant messages with ``tool_calls``), results (tool messages with
``tool_call_id``) and plain messages; they are parsed once and written by kind. Calls and results meet
by (conversation, identifier): counts and the earliest result of each key are pre-aggregated, then
hash-joined to the calls. Arguments are validated against schemas; every row is serialised as
canonical JSON (sorted keys, no spaces, normal numbers).

Topological order: a call may name calls that it comes ``after``. Its ``stage`` is the number of calls
on the longest chain that it comes after, in every conversation alike, so (conv_id, stage, turn, pos) is
an order in which nothing comes before what it needs. Longest chains are found by doubling: each call
knows the far end of the longest chain found so far and adds the chain of that end to its own, so a
chain of n calls takes about log2(n) rounds. A chain longer than the conversation has calls is a
cycle: calls on a cycle, and calls after them, have a null stage.

No group is gathered: a conversation of any size is spread over tasks by its call identifiers, and
rows are returned one by one.

Defined cases: null or empty text is a plain message with content null or empty; a message that is no
valid JSON of the two forms is plain; a result whose content is null or absent has content null; a call
without an id can't be linked and has stage 0, whatever it names; several results of a call: the
earliest is linked and their number given; results without a call are kept,
unlinked; calls that share an identifier are one call for the order, each get the result and are
flagged; references to absent calls are ignored; null conversations are never linked; repeated rows are
repeated; long turns are read whole; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import saved

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
RESULT = "tool_call_id string, content string"
#: Names of JSON types and how the engine writes the type of a value.
TYPES = {"string": "STRING", "integer": "(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
#: The schema of calls made from turns: a prompt of a few words at least and of bounded length.
REPLY = {"reply": {"properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 100_000}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 5}}, "required": ["prompt", "turn", "words"]}}
KEYS = ["conv_id", "call_id"]
WITH_NULLS = {"ignoreNullFields": "false"}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without spaces; null if it is not valid."""
    return F.to_json(F.try_parse_json(json))


def violations(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call, in schema order; empty if it is valid.

    A schema has ``properties`` (argument to type, or to ``type`` with ``minLength``, ``maxLength``,
    ``minimum``, ``maximum``, ``enum`` or ``pattern``) and ``required``; other arguments are allowed.
    """
    value = F.try_parse_json(arguments)
    shape = F.schema_of_variant(value)
    out = [F.when(value.isNull() | ~shape.startswith("OBJECT"), F.lit("arguments: not an object")), F.when(name.isNull() | ~name.isin(*schemas), F.lit("name: unknown"))]
    for tool, schema in schemas.items():
        for arg, rule in schema.get("properties", {}).items():
            rule = {"type": rule} if isinstance(rule, str) else rule
            path = f"$['{arg}']"
            got = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            if arg in schema.get("required", ()):
                out.append(F.when((name == tool) & shape.startswith("OBJECT") & got.isNull(), F.lit(f"{arg}: missing")))
            typed = got.rlike(f"^{TYPES[rule['type']]}$")
            out.append(F.when((name == tool) & got.isNotNull() & ~typed, F.lit(f"{arg}: not {rule['type']}")))
            text, number = F.try_variant_get(value, path, "string"), F.try_variant_get(value, path, "double")
            bounds = {
                "minLength": (F.char_length(text), "<", "shorter than"), "maxLength": (F.char_length(text), ">", "longer than"),
                "minimum": (number, "<", "less than"), "maximum": (number, ">", "more than"),
            }
            for key, (measure, sign, words) in bounds.items():
                if key in rule:
                    over = measure < rule[key] if sign == "<" else measure > rule[key]
                    out.append(F.when((name == tool) & typed & over, F.lit(f"{arg}: {words} {rule[key]}")))
            if "enum" in rule:
                out.append(F.when((name == tool) & typed & ~text.isin(*map(str, rule["enum"])), F.lit(f"{arg}: not allowed")))
            if "pattern" in rule:
                out.append(F.when((name == tool) & typed & ~text.rlike(rule["pattern"]), F.lit(f"{arg}: no match")))
    return F.array_compact(F.array(*out))


def item(kind: str, call_id: Column | None = None, name: Column | None = None, body: Column | None = None, after: Column | None = None, pos: Column | None = None) -> Column:
    """One thing that a message holds; ``body``: arguments, result or text."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), (F.lit(0) if pos is None else pos).alias("pos"), (none if call_id is None else call_id).alias("call_id"), (none if name is None else name).alias("name"),
        (none if body is None else body).alias("body"), (F.lit(None).cast("array<string>") if after is None else after).alias("after"),
    )


def items(messages: DataFrame, pair_turns: bool = False) -> DataFrame:
    """(conv_id, turn, kind, pos, call_id, name, body, after) of (conv_id, turn, role, text).

    ``pair_turns``: a user's plain turn t is a call of ``reply`` with id ``turn-t`` that comes after the
    user's turns among the two before it, and an assistant's plain turn is the result of the turn
    before it.
    """
    role, text, turn = F.col("role"), F.col("text"), F.col("turn")
    json = F.ltrim(text).startswith("{")
    calls = F.when(json & (role == "assistant"), F.from_json("text", CALLS)["tool_calls"])
    result = F.when(json & (role == "tool"), F.from_json("text", RESULT))
    rows = messages.select("conv_id", "turn", "role", "text", calls.alias("calls"), result.alias("result"))
    calls = F.transform("calls", lambda c, i: item("call", c["id"], c["name"], c["arguments"], c["after"], i))
    found = F.when(F.size("calls") > 0, calls).when(F.col("result.tool_call_id").isNotNull(), F.array(item("result", F.col("result.tool_call_id"), None, F.col("result.content"))))
    if pair_turns:
        name = lambda back: F.concat(F.lit("turn-"), turn - back)
        arguments = F.to_json(F.struct(text.alias("prompt"), turn.alias("turn"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("words")), WITH_NULLS)
        found = found.when((role == "user") & turn.isNotNull(), F.array(item("call", name(0), F.lit("reply"), arguments, F.array(name(1), name(2)))))
        found = found.when((role == "assistant") & turn.isNotNull(), F.array(item("result", name(1), None, text)))
    found = found.otherwise(F.array(item("message", None, role, text)))
    return rows.select("conv_id", "turn", F.inline(found))


def stages(calls: DataFrame, known: DataFrame) -> DataFrame:
    """(conv_id, call_id, stage) of the calls that come after known ones; ``known``: keys of calls.

    ``depth``: length of the longest chain found from a call, ``far``: its other end. Each round
    lengthens it by an edge or by the chain of its far end, whichever gives more. ``cap``: a length that no
    chain without a cycle has.
    """
    edges = calls.where("conv_id is not null and call_id is not null").select("conv_id", "call_id", F.explode("after").alias("dep"))
    edges = edges.join(known.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"]).distinct()
    nodes = edges.select(*KEYS).distinct().groupBy("conv_id").agg((F.count("*") + 1).alias("cap"))
    edges = saved(edges.join(nodes, "conv_id"), "after")
    state = saved(edges.groupBy(*KEYS).agg(F.lit(1).cast("long").alias("depth"), F.max("dep").alias("far"), F.first("cap").alias("cap")), "stages")
    changed = not state.isEmpty()
    while changed:
        end = state.select("conv_id", F.col("call_id").alias("dep"), F.col("depth").alias("more"), F.col("far").alias("farther"))
        by_edge = edges.join(end, ["conv_id", "dep"]).select(*KEYS, (F.col("more") + 1).alias("depth"), F.col("farther").alias("far"), "cap")
        by_jump = state.withColumnRenamed("far", "dep").join(end, ["conv_id", "dep"]).select(*KEYS, (F.col("depth") + F.col("more")).alias("depth"), F.col("farther").alias("far"), "cap")
        found = by_edge.unionByName(by_jump).withColumn("depth", F.least("depth", "cap")).select(*KEYS, "depth", "far", "cap", F.lit(1).alias("new"))
        best = F.max_by(F.struct("far", "new"), F.struct("depth", F.lit(1) - F.col("new"), "far"))  # the old chain unless a new one is longer
        rows = found.unionByName(state.select(*KEYS, "depth", "far", "cap", F.lit(0).alias("new"))).groupBy(*KEYS).agg(F.max("depth").alias("depth"), best.alias("b"), F.first("cap").alias("cap"))
        rows = saved(rows.select(*KEYS, "depth", F.col("b.far").alias("far"), "cap", F.col("b.new").alias("new")), "stages", instead_of=state)
        changed = not rows.where("new = 1").isEmpty()
        state = rows.drop("new")
    return state.select(*KEYS, F.when(F.col("depth") < F.col("cap"), F.col("depth").cast("int")).alias("stage"), F.lit(True).alias("later"))


def linked(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call, unlinked result and plain message of ``items``."""
    rows = saved(rows, "messages", by=("kind",))
    calls, results, said = (rows.where(F.col("kind") == k).drop("kind") for k in ("call", "result", "message"))
    keyed = rows.where("kind in ('call', 'result') and conv_id is not null and call_id is not null")
    is_call = F.col("kind") == "call"
    keys = saved(
        keyed.groupBy(*KEYS).agg(
            F.count_if(is_call).alias("n_same"), F.count_if(~is_call).alias("n_results"),
            F.min(F.when(~is_call, F.struct("turn", F.col("body").alias("content")))).alias("r"),
        ),
        "keys",
    )
    staged = stages(calls, keys.where("n_same > 0"))
    wide = calls.join(keys.hint("shuffle_hash"), KEYS, "left").join(staged, KEYS, "left")
    body = F.struct(
        F.coalesce(F.try_parse_json("body"), F.to_variant_object(F.struct(F.col("body").alias("invalid")))).alias("arguments"),
        F.col("call_id").alias("id"), "name", F.col("r.content").alias("result"),
    )
    stage = F.when(F.col("later"), F.col("stage")).otherwise(F.lit(0)).alias("stage")
    out = wide.select(
        "conv_id", "turn", "pos", F.lit("call").alias("kind"), "call_id", "name", stage, (F.coalesce("n_same", F.lit(1)) > 1).alias("shared_id"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.array_join(violations(F.col("name"), F.col("body"), schemas), "; ").alias("errors"), F.to_json(body).alias("json"),
    )
    plainly = ["conv_id", "turn", "pos"], [F.lit(0).alias("stage"), F.lit(False).alias("shared_id"), F.lit(0).cast("long").alias("n_results")]
    none = F.lit(None).cast("string")
    lost = results.join(keys.where("n_same > 0").select(*KEYS), KEYS, "left_anti")
    lost = lost.select(*plainly[0], F.lit("result").alias("kind"), "call_id", none.alias("name"), *plainly[1], F.lit("no call").alias("errors"), F.to_json(F.struct(F.col("body").alias("content"), F.col("call_id").alias("id")), WITH_NULLS).alias("json"))
    said = said.select(*plainly[0], F.lit("message").alias("kind"), none.alias("call_id"), none.alias("name"), *plainly[1], F.lit("").alias("errors"), F.to_json(F.struct(F.col("body").alias("content"), F.col("name").alias("role")), WITH_NULLS).alias("json"))
    return out.unionByName(lost).unionByName(said)


def formatted(messages: DataFrame, schemas: dict[str, dict], pair_turns: bool = False) -> DataFrame:
    """Links a chat table (conv_id, turn, role, text). ``pair_turns``: see ``items``."""
    return linked(items(messages, pair_turns), {**REPLY, **schemas} if pair_turns else schemas)


#: The same for ``pair_turns`` as DuckDB SQL, for tables without JSON messages. A call comes after the
#: one before it if that is at most two turns back, so its stage is its place in such a run.
ORACLE = r"""
with calls as (select conv_id, turn, 'turn-' || turn as call_id, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as words from conversations where role = 'user' and turn is not null),
results as (select conv_id, turn, 'turn-' || (turn - 1) as call_id, text from conversations where role = 'assistant' and turn is not null),
nodes as (select distinct conv_id, turn from calls),
starts as (select *, case when turn - lag(turn) over (partition by conv_id order by turn) <= 2 then 0 else 1 end as fresh from nodes),
runs as (select *, sum(fresh) over (partition by conv_id order by turn) as run from starts),
staged as (select conv_id, turn, (row_number() over (partition by conv_id, run order by turn) - 1)::int as stage from runs),
first as (select conv_id, call_id, count(*) as n, (min({'turn': turn, 'text': text})).text as content from results group by all),
same as (select conv_id, call_id, count(*) as n from calls group by all),
args as (select *, '{"prompt":' || coalesce(to_json(text)::varchar, 'null') || ',"turn":' || turn || ',"words":' || words || '}' as arguments from calls)
select a.conv_id, a.turn, 0 as pos, 'call' as kind, a.call_id, 'reply' as name, stage, same.n > 1 as shared_id, coalesce(first.n, 0) as n_results,
  concat_ws('; ', case when text is null then 'prompt: not string' end, case when length(text) < 1 then 'prompt: shorter than 1' end, case when length(text) > 100000 then 'prompt: longer than 100000' end,
    case when a.turn < 0 then 'turn: less than 0' end, case when words < 5 then 'words: less than 5' end) as errors,
  '{"arguments":' || arguments || ',"id":"' || a.call_id || '","name":"reply"' || coalesce(',"result":' || to_json(content)::varchar, '') || '}' as json
from args a join staged on staged.conv_id = a.conv_id and staged.turn = a.turn left join same on same.conv_id = a.conv_id and same.call_id = a.call_id left join first on first.conv_id = a.conv_id and first.call_id = a.call_id
union all
select r.conv_id, r.turn, 0, 'result', r.call_id, null, 0, false, 0, 'no call', '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"id":"' || r.call_id || '"}'
from results r where not exists (select 1 from calls c where c.conv_id = r.conv_id and c.call_id = r.call_id)
union all
select conv_id, turn, 0, 'message', null, null, 0, false, 0, '', '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}'
from conversations where role is null or role not in ('user', 'assistant') or turn is null
"""
