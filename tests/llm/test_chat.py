"""Chat formatting: links, order, validation and canonical JSON."""

import json

from newswarden.llm import chat

TOOLS = [chat.Tool("add", {"a": "number", "b": "number"}, ("a", "b")), chat.Tool("say", {"text": "string", "n": "integer", "f": "boolean", "o": "object", "l": "array"}, ("text",))]


def call(i, name, args):
    return {"id": i, "name": name, "arguments": args}


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    return {(r.conv_id, r.part): r for r in chat.formatted(df, TOOLS, **options).collect()}


def test_links_order_and_validation(spark):
    calls = [call("c2", "say", {"text": "$c1"}), call("c1", "add", {"b": 2, "a": 1.5}), call("c3", "say", {"text": "x", "n": 1, "f": True, "o": {"z": 1, "a": [2, {"q": 1, "b": 2}]}, "l": []}), call("c4", "say", {"n": "x", "zz": 1})]
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"content": "ok", "tool_calls": calls})), (1, 2, "tool", '{"tool_call_id":"c1","content":"3.5"}'), (1, 3, "tool", '{"tool_call_id":"c1","content":"later"}'), (1, 3, "tool", '{"tool_call_id":"zz","content":"?"}')]
    r = run(spark, rows)[1, 0]
    assert (r.n_messages, r.n_calls, r.n_linked, r.n_invalid, r.n_orphans, r.n_cyclic) == (5, 4, 1, 1, 1, 0)
    got = json.loads(r.chat)
    assert [c["id"] for c in got["calls"]] == ["c1", "c3", "c4", "c2"] and got["calls"][0]["result"] == "3.5"
    assert [c["level"] for c in got["calls"]] == [0, 0, 0, 1] and got["calls"][2]["errors"] == ["n is no integer", "missing text", "unknown zz"]
    assert r.chat == json.dumps(got, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_odd_cases(spark):
    rows = [(None, 0, "user", "x"), (2, None, None, None), (2, None, None, None), (3, 0, "assistant", json.dumps({"tool_calls": [call("p", "say", {"text": "$q"}), call("q", "say", {"text": "$p"}), call("p", "nope", {})]})), (4, 0, "user", "{not json"), (4, 1, "user", ""), (4, 9000, "user", "é" * 50000)]
    got = run(spark, rows)
    assert json.loads(got[None, 0].chat) == {"messages": [{"content": "x", "role": "user", "turn": 0}]}
    assert got[2, 0].chat == '{"conv_id":2,"messages":[{}]}' and got[2, 0].n_messages == 1
    assert got[3, 0].n_calls == 3 and got[3, 0].n_cyclic == 2
    assert [m["content"] for m in json.loads(got[4, 0].chat)["messages"]] == ["{not json", ""] and (4, 2) in got
    assert run(spark, []) == {}


def test_whole_table_against_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append({"content": r.text, "role": r.role, "turn": r.turn})
    got = {r.conv_id: r.chat for r in chat.formatted(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).collect()}
    assert got == {k: json.dumps({"conv_id": k, "messages": v}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for k, v in want.items()}


def test_marks_late_turns_and_calls_without_identifier(spark):
    calls = [call("!a", "say", {"text": "$b"}), call("b", "say", {"text": "x"}), call(None, "say", {"text": "y"})]
    rows = [(1, 5000, "assistant", json.dumps({"tool_calls": calls})), (1, 5001, "tool", '{"tool_call_id":"zz","content":"?"}'), (1, 9000, "assistant", json.dumps({"tool_calls": [call("late", "say", {"text": "$!a"})]}))]
    got = run(spark, rows)
    first = json.loads(got[1, 1].chat)
    assert [c.get("id") for c in first["calls"]] == ["b", None, "!a"] and (got[1, 1].n_calls, got[1, 1].n_orphans, got[1, 1].n_cyclic) == (3, 1, 0)
    assert json.loads(got[1, 2].chat)["calls"][0]["level"] == 1  # a reference into another part


def test_repeated_identifiers_go_to_the_call_before(spark):
    rows = [(1, t, "assistant", json.dumps({"tool_calls": [call("x", "say", {"text": str(t)})]})) for t in (1, 3, 5)]
    rows += [(1, 2, "tool", '{"tool_call_id":"x","content":"two"}'), (1, 6, "tool", '{"tool_call_id":"x","content":"six"}')]
    r = run(spark, rows)[1, 0]
    assert [c.get("result") for c in json.loads(r.chat)["calls"]] == ["two", None, "six"] and (r.n_calls, r.n_linked) == (3, 2)


def kahn(refs):
    """Levels as the docstring defines them, call by call."""
    level, left = {}, set(range(len(refs)))
    while ready := {i for i in left if all(j in level for j in refs[i])}:
        new = {i: max([level[j] + (j >= i) for j in refs[i]], default=0) for i in ready}
        level |= new
        left -= ready
    return [level.get(i) for i in range(len(refs))]


def test_levels_in_arrays_and_by_joins_against_python(spark):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(40):
        n = rng.randint(1, 12)
        refs = [[j for j in range(n) if rng.random() < 0.12] for _ in range(n)]
        want[conv] = kahn(refs)
        rows += [(conv, t, "assistant", json.dumps({"tool_calls": [call(f"k{t}", "say", {"text": " ".join(f'"${j}"' for j in []), "l": [f"$k{j}" for j in refs[t]]})]})) for t in range(n)]
    for limit in (1000, 0):
        got = run(spark, rows, array_calls=limit, part_turns=5)
        found = {}
        for (conv, _), r in got.items():
            found.setdefault(conv, {}).update({int(c["id"][1:]): c.get("level") for c in json.loads(r.chat)["calls"]})
        assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == want


def test_many_calls_and_many_messages_of_one_turn(spark):
    import time

    calls = [call(f"c{i}", "say", {"text": f"$c{i + 1}" if i % 50 == 0 else "x"}) for i in range(1500)]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls})), *((2, None, "user", f"m{i}") for i in range(500))]
    began = time.time()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(df, TOOLS, piece_messages=100).collect()
    assert time.time() - began < 60
    assert next(r.n_calls for r in out if r.conv_id == 1) == 1500 and next(r.n_cyclic for r in out if r.conv_id == 1) == 0
    pieces = [r for r in out if r.conv_id == 2]
    assert len(pieces) == 5 and sum(r.n_messages for r in pieces) == 500
