"""Chat formatting: tool-call linking with DataFrame operations only.

Messages are rows (conv_id, turn, role, text). Tool calls and results are joined by their
identifier in a hash join; messages are ordered topologically by depth along the links
(a result follows its call, any other message the one before it, whatever the gap between
their turns), found by pointer doubling so that one very long
conversation needs a logarithmic number of joins; position numbers a conversation's turns from 1 in that order.
Neighbours and positions come from a range sort whose partitions are numbered
separately and then shifted, so that no task holds a conversation whole. Arguments are
validated against a table of field schemas; messages are serialised as canonical JSON (keys
sorted, no spaces, null fields left out).

Cases: a result without a call is an orphan, a call without a result is open; a repeated
identifier is resolved to its first call (smallest turn); links that run in a circle
have a null depth and come last; a null conversation or turn has neither depth nor position; arguments that are not a JSON object are invalid and serialised as a
string; null texts and null roles are left out of the JSON; empty tables give no rows.
Repeated (conv_id, turn) rows share their links and are each returned. Columns other than
the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import common

#: Names that Spark gives to the types of JSON values, by JSON schema type.
JSON_TYPES = {
    "string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"], "null": ["VOID"],
    "number": ["BIGINT", "DOUBLE", "DECIMAL"], "object": ["OBJECT"], "array": ["ARRAY"],
}


def canonical(json_text: Column) -> Column:
    """JSON text with sorted keys and no spaces; null if it does not parse."""
    return F.to_json(F.try_parse_json(json_text))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Hash-join calls (conv_id, call_id, turn, ...) and results (conv_id, call_id, turn, ...).

    Returns (conv_id, call_id, call_turn, result_turn, status) with status linked, open or orphan.
    """
    first = lambda df, name: df.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias(name))
    a, b = first(calls, "call_turn").alias("a"), first(results, "result_turn").alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.call_id") == F.col("b.call_id"))
    joined = a.hint("shuffle_hash").join(b.hint("shuffle_hash"), same, "full")
    status = F.when(F.col("result_turn").isNull(), "open").when(F.col("call_turn").isNull(), "orphan").otherwise("linked")
    return joined.select(
        F.coalesce("a.conv_id", "b.conv_id").alias("conv_id"), F.coalesce("a.call_id", "b.call_id").alias("call_id"),
        "call_turn", "result_turn", status.alias("status"),
    )


def depths(nodes: DataFrame) -> DataFrame:
    """Depth of each node in a forest of (node, parent): (node, depth), null on a circle.

    Parents that are no node count as absent. Each round doubles the distance that a pointer
    spans; rounds are written to the shared folder.
    """
    base = nodes.groupBy("node").agg(F.min("parent").alias("parent"))
    known = base.select(F.col("node").alias("known"))
    start = base.join(known, base.parent == known.known, "left").select("node", F.col("known").alias("up"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    now, limit = common.Stage(start, "depths"), None
    spans = 1
    while True:
        open_rows = now.df.filter("up is not null").count()
        if not open_rows:
            return now.df.select("node", "depth")
        limit = limit or now.df.count()
        if spans > limit:  # what is left runs in circles
            return now.df.select("node", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
        far = now.df.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = now.df.filter("up is not null").join(far, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        after = common.Stage(step.unionByName(now.df.filter("up is null")), "depths")
        now.drop()
        now, spans = after, spans * 2


def in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows of (conv_id, *by) with position, from 1 in by's order within their conversation, and
    before: the turn one position ahead, if any. A sorted partition is the most that a task meets."""
    cut = common.Stage(rows.repartitionByRange("conv_id", *by).withColumn("_part", F.spark_partition_id()), "ordered").df
    chunk = Window.partitionBy("conv_id", "_part").orderBy(*by)
    ends = common.Stage(cut.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"), F.max(F.struct(*by, F.col("turn").alias("_turn")))["_turn"].alias("_last")), "chunks").df
    chunks = Window.partitionBy("conv_id").orderBy("_part")  # no more rows than partitions
    shifts = common.Stage(ends.select("conv_id", "_part", F.coalesce(F.sum("_n").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"), F.lag("_last").over(chunks).alias("_ahead")), "shifts").df
    numbered = cut.select("*", F.row_number().over(chunk).alias("_nth"), F.lag("turn").over(chunk).alias("_near")).join(shifts, ["conv_id", "_part"])
    return numbered.withColumns({"position": F.col("_nth") + F.col("_shift"), "before": F.coalesce("_near", "_ahead")}).drop("_part", "_nth", "_near", "_shift", "_ahead")


def turns_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, before) of each turn: the turn that comes ahead of it in its conversation."""
    rows = messages.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn")).distinct()
    return common.Stage(in_order(rows, ["turn"]).select("conv_id", "turn", "before"), "turns").df


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add valid to calls (name, arguments as JSON text, ...).

    schemas holds one row for each tool and field: (tool, field, type, required). A call is
    valid if its tool is known, its arguments are a JSON object, all required fields are
    there with a value other than null, all given fields are known and of their type. The
    schema of a tool is one row of arrays after grouping; its table is small by contract, and
    is joined by hash without a forced broadcast.
    """
    spec = schemas.groupBy("tool").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("field", "type")))).alias("_types"),
        F.collect_list(F.when(F.col("required"), F.col("field"))).alias("_required"),
    )
    given = calls.withColumn("_given", F.from_json("arguments", "map<string,variant>")).join(spec, calls["name"] == spec["tool"], "left")
    kinds = F.create_map(*[x for name, types in JSON_TYPES.items() for x in (F.lit(name), F.array(*map(F.lit, types)))])
    held = F.map_filter("_given", lambda k, v: v.isNotNull() & (F.schema_of_variant(v) != "VOID"))
    fits = F.forall(F.map_entries("_given"), lambda e: F.coalesce(F.array_contains(kinds[F.col("_types")[e["key"]]], F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0)), F.lit(False)))
    whole = F.size(F.array_except("_required", F.map_keys(held))) == 0
    valid = F.col("tool").isNotNull() & F.col("_given").isNotNull() & whole & fits
    return given.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_given", "_types", "_required", "tool")


def tool_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results found in messages: assistant texts {"tool_calls":[{"id","name","arguments"}]}
    and tool texts {"tool_call_id","content"}."""
    call = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
    calls = (
        messages.filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", call)["tool_calls"]).alias("c"))
        .select("conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    )
    results = messages.filter("role = 'tool'").select("conv_id", F.from_json("text", "struct<tool_call_id:string>")["tool_call_id"].alias("call_id"), "turn")
    return calls, results.filter("call_id is not null")


def reply_calls(messages: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain dialogue read as calls: a user turn calls the assistant, and an assistant's message is the result of the turn before it."""
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    args = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    calls = messages.filter("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), args.alias("arguments"))
    results = messages.filter("role = 'assistant'").join(turns.filter("before is not null"), ["conv_id", "turn"]).select("conv_id", name(F.col("before")).alias("call_id"), "turn")
    return calls, results


REPLY_SCHEMA = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True)]


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One row per message with its links, validity, topological depth and position, and canonical JSON.

    turns: what turns_of(messages) gives, if it is at hand.
    """
    turns = turns_of(messages) if turns is None else turns
    links = link(calls, results)
    checked = validate(calls, schemas)
    packed = (
        checked.join(links.select("conv_id", "call_id", "status"), ["conv_id", "call_id"], "left")
        .withColumn("_one", F.struct(
            F.col("call_id").alias("id"), F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("text")))).alias("arguments"),
            "name", "valid", F.coalesce("status", F.lit("open")).alias("status")))
        .groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("_one")).alias("_calls"))
    )
    answered = (
        results.groupBy("conv_id", "turn").agg(F.min("call_id").alias("call_id"))
        .join(links.select("conv_id", "call_id", "call_turn", F.col("status").alias("_how")), ["conv_id", "call_id"], "left")
        .select("conv_id", "turn", F.col("call_id").alias("_answers"), "call_turn", "_how")
    )
    rows = messages.select("conv_id", "turn", "role", "text")
    # a result follows its call; any other message follows the turn before it
    steps = turns.join(answered.select("conv_id", "turn", "call_turn"), ["conv_id", "turn"], "left")
    node = lambda turn: F.struct("conv_id", turn.cast("long").alias("turn"))
    forest = steps.select(node(F.col("turn")).alias("node"), node(F.coalesce("call_turn", "before")).alias("parent"))
    deep = depths(forest).select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), "depth")
    placed = in_order(deep.withColumn("_circle", F.col("depth").isNull()), ["_circle", "depth", "turn"])
    depth = placed.select("conv_id", "turn", "depth", F.col("position").cast("long").alias("position"))
    joined = (
        rows.join(packed, ["conv_id", "turn"], "left").join(answered.drop("call_turn"), ["conv_id", "turn"], "left").join(depth, ["conv_id", "turn"], "left")
    )
    shown = F.transform("_calls", lambda c: F.concat(F.lit('{"arguments":'), c["arguments"], F.lit(',"id":'), _text(c["id"]), F.lit(',"name":'), _text(c["name"]), F.lit("}")))
    body = F.concat_ws(
        ",", *[F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value)) for key, value in (
            ("content", _text(F.col("text"))), ("role", _text(F.col("role"))), ("tool_call_id", _text(F.col("_answers"))),
            ("tool_calls", F.when(F.size("_calls") > 0, F.concat(F.lit("["), F.concat_ws(",", shown), F.lit("]")))))],
    )
    return joined.select(
        "conv_id", "turn", "role", F.coalesce(F.size("_calls"), F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce(F.forall("_calls", lambda c: c["valid"]), F.lit(True)).alias("valid"),
        F.coalesce("_how", F.when(F.size("_calls") > 0, F.col("_calls")[0]["status"]), F.lit("plain")).alias("status"),
        F.col("_answers").alias("answers"), "depth", "position", F.concat(F.lit("{"), body, F.lit("}")).alias("json"),
    )


def _text(value: Column) -> Column:
    """A JSON string literal."""
    whole = F.to_json(F.array(value))
    return F.when(value.isNotNull(), whole.substr(F.lit(2), F.length(whole) - 2))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    messages = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns_of(messages)
    calls, results = reply_calls(messages, turns)
    more_calls, more_results = tool_calls(messages)
    tools = spark.createDataFrame(REPLY_SCHEMA, "tool string, field string, type string, required boolean")
    return format_chats(messages, calls.unionByName(more_calls), results.unionByName(more_results), tools, turns)


OP9_SQL = """
with m as (select conv_id, turn, role, text from conversations),
calls as (select conv_id, turn, min(text) t0, count(distinct text) nt, bool_and(text is not null) ok from m where role = 'user' group by all),
res as (select distinct conv_id, turn from m where role = 'assistant'),
steps as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) before, row_number() over (partition by conv_id order by turn) position from (select distinct conv_id, turn from m)),
calling as (select c.conv_id, c.turn, bool_or(r.turn is not null) answered from calls c left join steps s on s.conv_id = c.conv_id and s.before = c.turn
            left join res r on r.conv_id = s.conv_id and r.turn = s.turn group by all)
select m.conv_id, m.turn, m.role,
  case when role = 'user' then 1 else 0 end::bigint n_calls,
  case when role = 'user' then m.text is not null else true end valid,
  case when role = 'assistant' and before is not null then (case when c.conv_id is null then 'orphan' else 'linked' end)
       when role = 'user' then (case when own.answered then 'linked' else 'open' end) else 'plain' end status,
  case when role = 'assistant' and before is not null then 'call_' || m.conv_id || '_' || before end answers,
  position - 1 depth, position,
  '{"content":' || to_json(m.text)::varchar || ',"role":' || to_json(m.role)::varchar
  || case when role = 'assistant' and before is not null then ',"tool_call_id":' || to_json('call_' || m.conv_id || '_' || before)::varchar else '' end
  || case when role = 'user' then ',"tool_calls":[{"arguments":{"prompt":' || to_json(m.text)::varchar || ',"turn":' || m.turn || '},"id":"call_' || m.conv_id || '_' || m.turn || '","name":"reply"}]' else '' end
  || '}' json
from m join steps s on s.conv_id = m.conv_id and s.turn = m.turn
left join calls c on c.conv_id = m.conv_id and c.turn = s.before
left join calling own on own.conv_id = m.conv_id and own.turn = m.turn
"""
