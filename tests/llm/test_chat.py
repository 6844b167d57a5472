import json

from pyspark.sql import functions as F

from gridloom.llm import chat

SCHEMA = "tool string, field string, type string, required boolean"


def run(spark, messages, schemas=()):
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").withColumn("DEPTH", F.lit("x"))
    calls, results = chat.tool_calls(df)
    return chat.format_chats(df, calls, results, spark.createDataFrame(list(schemas), SCHEMA))


def test_links_validation_and_canonical_json(spark):
    schemas = [("sum", "b", "integer", True), ("sum", "a", "number", True), ("sum", "note", "string", False)]
    call = lambda i, args: {"id": i, "name": "sum", "arguments": args}
    text = lambda *calls: json.dumps({"tool_calls": list(calls)})
    messages = [
        (1, 0, "user", "add"),
        (1, 1, "assistant", text(call("x", '{"b": 2, "a": 1.5}'), call("y", '{"b": "2", "a": 1}'))),
        (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": "3.5"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "lost", "content": ""})),
        (2, 0, "assistant", text(call("z", "not json"))),
        (2, 1, "assistant", text(call("n", '{"a": null, "b": 1}'))),
        (2, 2, "assistant", text(call("ok", '{"a": 1, "b": 1, "note": "é\\n"}'))),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, messages, schemas).collect()}
    assert [got[k]["n_calls"] for k in sorted(got)] == [0, 2, 0, 0, 1, 1, 1]
    assert [got[k]["valid"] for k in sorted(got)] == [True, False, True, True, False, False, True]
    assert got[1, 2]["status"] == "linked" and got[1, 3]["status"] == "orphan" and got[2, 0]["status"] == "open"
    assert [got[1, t]["depth"] for t in range(4)] == [0, 1, 2, 3]
    first = json.loads(got[1, 1]["json"])
    assert got[1, 1]["json"].index('"arguments":{"a":1.5,"b":2},"id":"x"') and list(first) == ["content", "role", "tool_calls"]
    assert json.loads(got[1, 2]["json"])["tool_call_id"] == "x"
    assert json.loads(got[2, 0]["json"])["tool_calls"][0]["arguments"] == {"text": "not json"}


def test_depths_of_chains_and_circles(spark):
    nodes = [(i, i - 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 200)]
    got = {r["node"]: r["depth"] for r in chat.depths(spark.createDataFrame(nodes, "node long, parent long")).collect()}
    assert all(got[i] == i for i in range(100)) and [got[i] for i in (200, 201, 202, 300)] == [None] * 4


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 1, "user", ""), (2, None, "tool", "{}"), (3, 0, "user", "x" * 200000)]
    out = run(spark, rows).collect()
    assert len(out) == 5 and {r["status"] for r in out} == {"plain"}
    assert run(spark, []).count() == 0


def test_order_follows_links_and_skips_gaps(spark):
    call = json.dumps({"tool_calls": [{"id": "x", "name": "sum", "arguments": "{}"}]})
    result = json.dumps({"tool_call_id": "x", "content": "3"})
    messages = [(1, 5, "user", "a"), (1, 9, "assistant", call), (1, 11, "user", "meanwhile"), (1, 12, "user", "and"), (1, 40, "tool", result), (1, 41, "assistant", "done")]
    got = {r["turn"]: r for r in run(spark, messages).collect()}
    assert [got[t]["depth"] for t in (5, 9, 11, 12, 40, 41)] == [0, 1, 2, 3, 2, 3]  # the result follows its call
    assert [got[t]["position"] for t in (5, 9, 11, 40, 12, 41)] == [1, 2, 3, 4, 5, 6]
    # a result ahead of its call waits for it; a circle comes last
    early = {r["turn"]: r for r in run(spark, [(1, 0, "user", "a"), (1, 1, "tool", result), (1, 2, "assistant", call)]).collect()}
    assert [early[t]["depth"] for t in range(3)] == [0, None, None] and [early[t]["position"] for t in range(3)] == [1, 2, 3]


def test_repeated_identifiers_go_to_the_first_call(spark):
    call = lambda name: json.dumps({"tool_calls": [{"id": "x", "name": name, "arguments": "{}"}]})
    result = json.dumps({"tool_call_id": "x", "content": "3"})
    messages = [(1, 0, "assistant", call("one")), (1, 1, "assistant", call("two")), (1, 2, "tool", result), (1, 3, "tool", result), (2, 0, "tool", result)]
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, messages).collect()}
    assert [got[1, t]["depth"] for t in range(4)] == [0, 1, 1, 1]
    assert [got[k]["status"] for k in sorted(got)] == ["linked"] * 4 + ["orphan"]


def test_long_conversation_spans_partitions(spark):
    turns = list(range(0, 3000, 3))
    df = spark.createDataFrame([(c, t, "user", "x") for c in (1, 2) for t in turns], "conv_id long, turn long, role string, text string").repartition(7)
    got = {(r["conv_id"], r["turn"]): (r["position"], r["before"]) for r in chat.in_order(df.select("conv_id", "turn"), ["turn"]).collect()}
    assert all(got[c, t] == (i + 1, turns[i - 1] if i else None) for c in (1, 2) for i, t in enumerate(turns))
