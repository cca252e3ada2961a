"""Tool-call linking against a linker that goes through each conversation."""

import json
import random

import pytest

from veilgraph.llm import chat

SCHEMA = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a"], "additionalProperties": False}}
ROWS = "conv_id long, turn long, role string, text string"


def call(i, name="add", args=None, after=()):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': {'a': 1} if args is None else args, 'after': list(after)})}</tool_call>"


def result(i, content="r"):
    return f"<tool_result>{json.dumps({'id': i, 'content': content})}</tool_result>"


def tool(name, parameters):
    return f"<tool_schema>{json.dumps({'name': name, 'parameters': parameters})}</tool_schema>"


def test_linking_ordering_and_validation(spark):
    rows = [
        (1, 0, "user", "do é \"it\""),
        (1, 1, "assistant", "sure " + call("x", after=["y"]) + call("y") + " done"),
        (1, 2, "tool", result("y", {"b": 1, "a": [2]}) + result("x")),
        (1, 3, "assistant", call("bad", args={"a": 1.5, "c": 0}) + call("who", name="nope") + call("y") + "<tool_call>{</tool_call>"),
        (1, 4, "tool", result("bad") + result("who") + result("ghost")),
        (2, 0, "assistant", call("p", after=["q"]) + call("q", after=["p"]) + call("m", after=["none"])),
        (2, 1, "tool", result("p") + result("q") + result("m")),
        (3, 0, None, None), (None, None, "user", "hi"), (3, 0, None, None),
    ]
    got = chat.link(spark.createDataFrame(rows, ROWS), SCHEMA).collect()
    status = {(r.conv_id, r.kind, r.call_id, r.turn): r.status for r in got}
    assert status[1, "call", "x", 1] == status[1, "result", "x", 2] == status[1, "call", "y", 1] == "ok"
    assert status[1, "call", "bad", 3] == "invalid $.a: not integer; $.c: not allowed"
    assert status[1, "call", "who", 3] == "invalid $: unknown tool" and status[1, "call", "y", 3] == "duplicate"
    assert status[1, "result", "ghost", 4] == "unlinked" and status[1, "malformed", None, 3] == "malformed"
    assert status[2, "call", "p", 0] == "cycle" and status[2, "call", "m", 0] == "missing"
    order = [(r.kind, r.call_id) for r in sorted((r for r in got if r.conv_id == 1 and r.turn in (1, 2)), key=lambda r: tuple(r.place))]
    assert order.index(("call", "y")) < order.index(("call", "x")) and order.index(("call", "x")) < order.index(("result", "x"))
    lines = [r.json for r in got]
    assert all(chat.canonical(json.loads(x)) == x for x in lines)
    assert '{"content":"do é \\"it\\"","kind":"message","role":"user"}' in lines
    assert sum(r.conv_id == 3 for r in got) == 2 and sum(r.conv_id is None for r in got) == 1


def test_declared_and_unchecked_tools(spark):
    rows = [
        (1, 0, "system", tool("add", SCHEMA["add"]) + tool("add", True) + tool("f", {"enum": [1]}) + "<tool_schema>{}</tool_schema>"),
        (1, 1, "assistant", call("a") + call("b", args={}) + call("c", name="f", args=True) + call("d", name="g") + result("a") + result("b") + result("c") + result("d")),
        (2, 0, "assistant", call("a") + result("a")),
    ]
    got = {(r.conv_id, r.kind, r.call_id, r.ord): r.status for r in chat.op7(spark.createDataFrame(rows, ROWS)).collect()}
    assert got[1, "schema", None, 1] == "ok" and got[1, "schema", None, 2] == "duplicate" and got[1, "malformed", None, 4] == "malformed"
    assert got[1, "call", "a", 1] == "ok" and got[1, "call", "b", 2] == "invalid $.a: missing"
    assert got[1, "call", "c", 3] == "invalid $: not in enum" and got[1, "call", "d", 4] == "invalid $: unknown tool"
    assert got[2, "call", "a", 1] == "unchecked" and got[2, "result", "a", 2] == "ok"


DEEP = '{"id": "d", "name": "add", "arguments": ' + "[" * 100_000 + "]" * 100_000 + "}"


@pytest.mark.parametrize(
    "content",
    [
        '{"id": "a", "name": "add", "after": 5}', '{"id": "a", "name": ["x"]}', '{"id": "a", "name": "add", "arguments": NaN}', '{"id": "a", "name": "add", "arguments": 1e999}',
        '{"id": "\\ud800", "name": "add"}', '{"id": "a", "name": "add", "arguments": "\\udfff"}', DEEP, '{"id": "a", "name": "add", "after": [1]}', "[1]", "null", "", '{"id": 1, "name": "add"}',
        '{"id": "a", "name": "add", "arguments": ' + "9" * 5000 + "}",
    ],
)
def test_malformed_calls(content):
    message, item = chat._items(f"x<tool_call>{content}</tool_call>y", "user")
    assert item[0] == "malformed" and json.loads(item[-1])["content"] == content
    assert json.loads(message[-1])["content"] == "xy"


def test_schemas_of_any_form():
    assert chat.faults(10**400, {"type": "integer"}) == [] and chat.faults(2.0, {"type": "integer"}) == []
    assert chat.faults(1, {"type": ["string", "integer"]}) == [] and chat.faults(1, {"type": ["string", "null"]}) == ["$: not string or null"]
    assert chat.faults(1, {"type": "thing"}) == ["$: not thing"] and chat.faults(1, {"type": {}}) == ["$: not {}"]
    assert chat.faults({"a": 1}, {"properties": 5}) == ["$: schema is malformed"] and chat.faults({"a": 1}, {"properties": {"a": 5}}) == ["$.a: schema is no object"]
    assert chat.faults(True, {"type": "number"}) == ["$: not number"] and chat.faults([1, "x"], {"items": {"type": "string"}}) == ["$[0]: not string"]


def test_unclosed_spans_take_linear_time():
    text = "<tool_call>" * 200_000 + "<tool_result>{}</tool_result>"
    assert [x[0] for x in chat._items(text, None)] == ["message", "malformed"]


def brute(rows):
    """(conv, kind, id, turn, ord): (status, level) by going through every conversation."""
    out, convs = {}, {}
    for conv, turn, _, text in rows:
        for i, x in enumerate(chat._items(text, None)):
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), i, turn, x))
    for conv, found in convs.items():
        found.sort(key=lambda f: f[:2])
        first = {}
        for key, i, turn, x in found:
            first.setdefault((x[0], x[2]), (key, i, x))
        calls = {k[1]: v[2] for k, v in first.items() if k[0] == "call"}
        results = {k[1] for k in first if k[0] == "result"}
        level, grown = {}, True
        while grown:
            new = {c for c, x in calls.items() if c not in level and all(d in level for d in x[4])}
            level |= {c: 1 + max([level[d] for d in calls[c][4]], default=-1) for c in new}
            grown = bool(new)
        for key, i, turn, x in found:
            if x[0] in ("call", "result"):
                c = x[2]
                status = "unchecked" if x[0] == "call" else "ok"
                if first[x[0], c][:2] != (key, i):
                    status = "duplicate"
                elif c not in calls or c not in results:
                    status = "unlinked"
                elif any(d not in calls for d in calls[c][4]):
                    status = "missing"
                elif c not in level:
                    status = "cycle"
                out[conv, x[0], c, turn, i] = (status, level.get(c, 0))
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(14)]:
        ids = [f"c{k}" for k in range(rng.randint(1, 9))]
        for turn in [None, *range(rng.randint(1, 6))]:
            text = ""
            for _ in range(rng.randint(0, 4)):
                i = rng.choice(ids)
                text += rng.choice([call(i, after=rng.sample(ids, rng.randint(0, min(2, len(ids))))), result(i), "plain ", call(i)])
            rows.append((conv, turn, "assistant", text))
    rows.append((99, 0, "assistant", "".join(call(f"k{i}", after=[f"k{i - 1}"] if i else []) + result(f"k{i}") for i in range(12))))
    got = {(r.conv_id, r.kind, r.call_id, r.turn, r.ord): (r.status, r.place.level) for r in chat.op7(spark.createDataFrame(rows, ROWS)).collect() if r.call_id}
    assert got == brute(rows)


def test_formatted_is_in_order(spark):
    rows = [(c, t, "assistant", call(f"i{t}") + result(f"i{t}")) for c in (2, 1) for t in (1, 0)]
    got = chat.formatted(chat.op7(spark.createDataFrame(rows, ROWS))).collect()
    assert [(r.conv_id, tuple(r.place)) for r in got] == sorted((r.conv_id, tuple(r.place)) for r in got)


def test_empty_table(spark):
    assert chat.op7(spark.createDataFrame([], ROWS)).count() == 0


def test_long_messages(spark):
    text = "".join(call(f"i{k}", after=[f"i{k - 1}"] if k % 50 else []) + result(f"i{k}", "r" * 300) for k in range(1500)) + "z" * 1_000_000
    got = chat.op7(spark.createDataFrame([(1, 0, "assistant", text)], ROWS)).collect()
    assert len(got) == 3001 and {r.status for r in got if r.kind == "result"} == {"ok"} and max(r.place.level for r in got) == 49
