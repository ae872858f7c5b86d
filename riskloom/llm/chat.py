"""Tool-call linking for chat data: calls and results are joined by identifier,
put in topological order, checked against schemas and written as canonical JSON.

Everything is one row per message; conversations are never gathered, so a
conversation may hold any share of the rows. Python reads and writes JSON only.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, store


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, UTF-8 unescaped, integers for whole floats below 2**53; non-finite numbers are null."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x == int(x) and abs(x) < 2**53 else x
        return x

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def _fits(x, kinds: type | tuple) -> bool:
    return isinstance(x, kinds) and not (isinstance(x, bool) and kinds is not bool)


def checked(schema, at: str = "$") -> None:
    """ValueError where a schema isn't one: found on the driver, before any row is read."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"schema {at}: neither an object nor true or false")
    kinds = schema.get("type", [])
    wrong = [] if isinstance(kinds, str) or (isinstance(kinds, list) and all(isinstance(k, str) for k in kinds)) else ["type"]
    wrong += [k for k in ("minimum", "maximum", "minLength", "maxLength") if k in schema and not _fits(schema[k], (int, float))]
    wrong += [k for k, kind in (("enum", list), ("required", list), ("properties", dict)) if k in schema and not isinstance(schema[k], kind)]
    if wrong:
        raise ValueError(f"schema {at}: {', '.join(wrong)} can't be read")
    inner = {f".{k}": x for k, x in schema.get("properties", {}).items()}
    items = schema.get("items", True)
    inner |= {f"[{i}]": x for i, x in enumerate(items)} if isinstance(items, list) else {"[]": items}
    for k, x in (inner | {".*": schema.get("additionalProperties", True)}).items():
        checked(x, at + k)


def problems(value, schema: dict | bool, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema (a type that no schema knows fits nothing): true, false, type, enum,
    required, properties, additionalProperties, items (one for all, or one for each), minimum, maximum, minLength, maxLength."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []

    def is_kind(k: str) -> bool:
        if k in ("number", "integer"):
            return _fits(value, (int, float)) and (k == "number" or isinstance(value, int) or value.is_integer())
        return k in _KINDS and isinstance(value, _KINDS[k])

    if kinds and not any(is_kind(k) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    # true isn't 1, and 1.0 is.
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not one of the values")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif others is False:
                out.append(f"{at}.{k}: unknown")
            else:
                out += problems(value[k], others, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        each = schema["items"]
        for i, (x, own) in enumerate(zip(value, each) if isinstance(each, list) else ((x, each) for x in value)):
            out += problems(x, own, f"{at}[{i}]")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: too long")
    if _fits(value, (int, float)) and (value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf)):
        out.append(f"{at}: out of range")
    return out


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], others: DataFrame | None = None) -> DataFrame:
    """One row per call, per result that has no call and per other message.

    calls: conv_id, call_id, turn, name, arguments (JSON text), needs (array of
    call ids in the same conversation whose results the call reads).
    results: conv_id, call_id, turn, content. others: conv_id, turn, content.

    Returns conv_id, call_id, turn, name, level, status, n_problems, message.
    level orders a conversation topologically: 0 for a call without needs, else
    one above its highest need; calls in a cycle, or behind one, have level null.
    status: `linked`, `unanswered`, `orphan` (result without call), `duplicate`
    (call or result whose id was used by an earlier turn, or is null), `cyclic`,
    `unlinked` (other message). n_problems counts breaches of the schema of the
    tool; an unknown tool is one, and so is JSON that can't be read (malformed, or
    nested deeper than Python's recursion goes), which stays a string. message is canonical JSON of the call with its
    result. Needs that name no call are ignored. Null ids never link. No rows
    give no rows; ties of turn go by content.
    """
    keys = ["conv_id", "call_id"]
    first = calls.where("call_id is not null and conv_id is not null").groupBy(*keys).agg(
        F.min(F.struct("turn", "name", "arguments")).alias("first"), F.min_by("needs", F.struct("turn", "name", "arguments")).alias("needs"), F.count(F.lit(1)).alias("n_calls")
    )
    answer = results.where("call_id is not null and conv_id is not null").groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("answer"), F.count(F.lit(1)).alias("n_results"))
    heads = store(first.join(answer, keys, "full").select(*keys, "first", "answer", "needs", "n_calls", "n_results"), "chat-linked")
    level = _levels(heads.df.where("first is not null").select(*keys, "needs"))
    rows = heads.df.join(level, keys, "left").select(
        *keys,
        F.coalesce("first.turn", "answer.turn").alias("turn"),
        F.col("first.name").alias("name"),
        F.when(F.col("first").isNotNull(), F.col("level")).alias("level"),
        F.when(F.col("first").isNull(), "orphan").when(F.col("level").isNull(), "cyclic").when(F.col("answer").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.col("first.arguments").alias("arguments"),
        F.col("answer.content").alias("content"),
        F.col("answer").isNotNull().alias("answered"),
    )
    # What repeats an id, or has none, is a row of its own.
    twice = lambda head, n: heads.df.where(F.col(n) > 1).select(*keys, F.col(head).alias("first"))
    spare_calls = _spares(calls, twice("first", "n_calls"), keys, ["turn", "name", "arguments"]).select(
        *keys, "turn", "name", F.lit(None).cast("int").alias("level"), F.lit("duplicate").alias("status"), "arguments", F.lit(None).cast("string").alias("content"), F.lit(False).alias("answered")
    )
    spare_results = _spares(results, twice("answer", "n_results"), keys, ["turn", "content"]).select(
        *keys, "turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.lit("duplicate").alias("status"), F.lit(None).cast("string").alias("arguments"), "content", F.lit(True).alias("answered")
    )
    rows = rows.unionByName(spare_calls).unionByName(spare_results)
    if others is not None:
        nothing = {c: F.lit(None).cast("string") for c in ("call_id", "name", "arguments")}
        left = others.select("conv_id", "turn", "content").withColumns(nothing | {"level": F.lit(None).cast("int"), "status": F.lit("unlinked"), "answered": F.lit(True)})
        rows = rows.unionByName(left)
    return _written(rows, schemas)


def _spares(rows: DataFrame, twice: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Rows without an id, and those beside the first of an id met twice; equal rows stand as often as they occur, less one for the first."""
    nameless = rows.where("call_id is null or conv_id is null").select(*keys, *parts)
    h = twice.select(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("first").alias("h"))
    both = rows.join(h, (F.col("conv_id") == F.col("h_conv_id")) & (F.col("call_id") == F.col("h_call_id")))
    counted = both.groupBy(*keys, *parts, "h").agg(F.count(F.lit(1)).alias("n"))
    same = F.struct(*parts).eqNullSafe(F.col("h"))
    left = counted.withColumn("n", F.col("n") - same.cast("int")).where("n > 0")
    return left.withColumn("_", F.explode(F.expr("sequence(1, cast(n as int))"))).select(*keys, *parts).unionByName(nameless)


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that are in no cycle and behind none.

    Chains of calls with one need each are followed by pointer doubling, so that
    a chain of n calls takes log n rounds; calls of several needs are settled in
    rounds over what such chains lead to.
    """
    keys = ["conv_id", "call_id"]
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
    names = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    edges = store(edges.join(names, (F.col("conv_id") == F.col("c")) & (F.col("need") == F.col("i")), "left_semi"), "chat-needs")
    roots = calls.select(*keys).join(edges.df.select(*keys).distinct(), keys, "left_anti").withColumn("level", F.lit(0))
    if edges.df.isEmpty():
        return roots
    needs = edges.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("up"))
    chain = store(needs.where("n = 1").select(*keys, "up", F.lit(1).alias("far"), F.lit(True).alias("moved")), "chat-chain")
    for _ in range(chain.df.count().bit_length() + 1):
        if chain.df.where("moved").isEmpty():
            break
        hop = chain.df.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("top"), F.col("far").alias("more"))
        jumped = chain.df.join(hop, ["conv_id", "up"], "left").select(*keys, F.coalesce("top", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("top").isNotNull().alias("moved"))
        after = store(jumped, "chat-chain")
        chain.drop()
        chain = after
    # What still moves after as many rounds goes round in a cycle; ends are calls with no need or with several.
    ends = chain.df.where("not moved").select("conv_id", "call_id", "up", "far")
    settled = store(roots, "chat-level")
    many = edges.df.join(needs.where("n > 1").select(*keys), keys, "left_semi")
    to = ends.select("conv_id", F.col("call_id").alias("need"), "up", "far")
    left = store(many.join(to, ["conv_id", "need"], "left").select(*keys, F.coalesce("up", "need").alias("need"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "chat-left")
    while not left.df.isEmpty():
        known = settled.df.select("conv_id", F.col("call_id").alias("need"), "level")
        seen = left.df.join(known, ["conv_id", "need"], "left").groupBy(*keys).agg(F.max(F.col("level") + F.col("far")).alias("level"), F.max(F.col("level").isNull()).alias("waits"))
        ready = store(seen.where("not waits").select(*keys, "level"), "chat-ready")
        if ready.df.isEmpty():
            break
        rest = store(left.df.join(ready.df.select(*keys), keys, "left_anti"), "chat-left")
        more = store(settled.df.unionByName(ready.df), "chat-level")
        for done in (left, settled, ready):
            done.drop()
        left, settled = rest, more
    top = settled.df.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("base"))
    return settled.df.unionByName(ends.join(top, ["conv_id", "up"]).select(*keys, (F.col("base") + F.col("far")).alias("level")))


def _written(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def make():
        def message(conv, call, name, args, value, content, answered) -> str:
            out = {"conversation": conv, "id": call}
            if name is not None or args is not None:
                out["call"] = {"name": name, "arguments": value}
            if answered:
                out["result"] = content
            return canonical(out).encode("utf-8", "replace").decode()  # half of a surrogate pair becomes "?"

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            wrong, text = [], []
            for conv, call, name, args, content, answered in zip(*map(get, ("conv_id", "call_id", "name", "arguments", "content", "answered"))):
                try:
                    value = None if args is None else json.loads(args)
                    n = 0 if name is None else len(problems(value, schemas[name])) if name in schemas else 1
                    said = message(conv, call, name, args, value, content, answered)
                except (ValueError, RecursionError):
                    n, said = 1, message(conv, call, name, args, args, content, answered)
                wrong.append(n)
                text.append(said)
            return [pa.array(wrong, pa.int64()), pa.array(text, pa.string())]

        return fn

    for name, schema in schemas.items():
        checked(schema, name)
    fields = [T.StructField("n_problems", T.LongType()), T.StructField("message", T.StringType())]
    return append_columns(rows, make, fields, ["conv_id", "call_id", "turn", "name", "level", "status"] + ["arguments", "content", "answered"]).drop("arguments", "content", "answered")


#: What a user's turn asks for, as a tool.
REPLY = {"reply": {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations without tool calls, read as such: a user's turn calls `reply`
    under the identifier of the turn that has to answer it and needs the call that
    the turn before it answered; an assistant's turn is the result under its own
    identifier; turns of other or null roles are other messages."""
    c = conversations.select("conv_id", "turn", "role", "text")
    calls = c.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).cast("string").alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.array((F.col("turn") - 1).cast("string")).alias("needs")
    )
    results = c.where("role = 'assistant'").select("conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    others = c.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", F.col("text").alias("content"))
    return calls, results, others


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op1_chat_formatting: every turn of conversations, linked, ordered and checked."""
    from .common import table

    calls, results, others = turns_as_calls(table(spark, sf_dir, "conversations"))
    linked = link_calls(calls, results, REPLY, others)
    return linked.select("conv_id", "call_id", "turn", "status", "level", "n_problems", F.sha2("message", 256).alias("message_sha256"))


ORACLE = """
with calls as (
  select conv_id, (turn + 1)::varchar as call_id, turn, text, row_number() over (partition by conv_id, turn order by to_json(text)::varchar) as k
  from conversations where role = 'user'
), runs as (
  select conv_id, turn, text, call_id, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as run from calls where k = 1
), levels as (
  select conv_id, turn, text, call_id, row_number() over (partition by conv_id, turn % 2, run order by turn) - 1 as level from runs
), results as (
  select conv_id, turn::varchar as call_id, turn, text, row_number() over (partition by conv_id, turn order by text) as k
  from conversations where role = 'assistant'
), linked as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, coalesce(c.turn, r.turn) as turn,
    case when c.conv_id is null then 'orphan' when r.conv_id is null then 'unanswered' else 'linked' end as status,
    c.level, c.conv_id is not null as called, c.text as ask, r.conv_id is not null as answered, r.text as reply, c.turn as asked
  from levels c full join (select * from results where k = 1) r on c.conv_id = r.conv_id and c.call_id = r.call_id
  union all
  select conv_id, call_id, turn, 'duplicate', null, true, text, false, null, turn from calls where k > 1
  union all
  select conv_id, call_id, turn, 'duplicate', null, false, null, true, text, null from results where k > 1
  union all
  select conv_id, null, turn, 'unlinked', null, false, null, true, text, null from conversations where role is null or role not in ('user', 'assistant')
)
select conv_id, call_id, turn, status, level::int as level,
  (case when not called then 0 when ask is null or ask = '' then 1 else 0 end)::bigint as n_problems,
  sha256('{' || case when called then '"call":{"arguments":{' || case when ask is null then '' else '"text":' || to_json(ask)::varchar || ',' end || '"turn":' || asked || '},"name":"reply"},' else '' end
    || '"conversation":' || conv_id || ',"id":' || coalesce('"' || call_id || '"', 'null') || case when answered then ',"result":' || coalesce(to_json(reply)::varchar, 'null') else '' end || '}') as message_sha256
from linked
"""
