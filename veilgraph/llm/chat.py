"""Chat formatting with tool-call linking.

A message's text may hold declared tools, ``<tool_schema>{"name", "parameters"}</tool_schema>``, tool calls,
``<tool_call>{"id", "name", "arguments", "after"}</tool_call>``, and results,
``<tool_result>{"id", "content"}</tool_result>``. They are taken out of the text; calls and results are
hash-joined by conversation and id; arguments are checked against the schema that the conversation
declares for the call's name (or one given for all conversations); calls that wait for others
(``after``) get a level by repeated joins, each over the waits still open, and a result stands
after its call. Every message, schema, call and result becomes one canonical JSON line (sorted keys, no spaces), and
``place`` orders the lines of a conversation. No conversation is gathered in one
task: places come from joins, and :func:`formatted` lays the lines out by ranges of (conversation, place), so a
reader of the files has every conversation in its order, also one that fills several of them.

Status, the first that holds: ``malformed`` (no JSON object, a NaN, a lone surrogate, nesting too deep to read, a
call without text id and name, ``after`` that is no list of texts), ``duplicate`` (of calls, of results or of schemas under one id or
name in a conversation the first counts; rows repeated whole count alike), ``invalid`` with what is wrong, ``unlinked`` (a result
without a call, a call without a result), ``missing`` and ``cycle`` (calls that wait for ones that are not there, or for
each other), ``unchecked`` (no schemas are known in the conversation), ``ok``.

Defined results: a null text is an empty message; rows without conv_id form one conversation of their own; a null turn
comes first; repeated rows are repeated messages; an empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .scratch import drop, stash

OPEN = re.compile(r"<tool_(call|result|schema)>")
NUMBER = (int, float)
KINDS = {"string": (str,), "boolean": (bool,), "array": (list,), "object": (dict,), "null": (type(None),)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(constant):
    raise ValueError(constant)


def parsed(text: str):
    """The JSON value of ``text``; ValueError where it is none, or none that UTF-8 can hold."""
    try:
        value = json.loads(text, parse_constant=_refuse)
        canonical(value).encode("utf-8")  # lone surrogates and infinite numbers end here
        return value
    except RecursionError as error:
        raise ValueError("nested too deep") from error


def _is(value, kind) -> bool:
    if kind in ("integer", "number"):
        whole = kind == "number" or isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return isinstance(value, NUMBER) and not isinstance(value, bool) and whole
    return isinstance(kind, str) and kind in KINDS and isinstance(value, KINDS[kind])


def faults(value, schema, at: str = "$") -> list[str]:
    """What is wrong with ``value`` under a JSON schema (type, enum, required, properties, additionalProperties, items).

    Keywords of a form that this function does not know, in a schema, are faults themselves.
    """
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return [f"{at}: schema is no object"]
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind]
    if kind is not None and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(map(str, kinds))}"]
    out = []
    enum = schema.get("enum")
    if enum is not None and not (isinstance(enum, list) and canonical(value) in map(canonical, enum)):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known, needed, other = schema.get("properties", {}), schema.get("required", []), schema.get("additionalProperties", True)
        if not isinstance(known, dict) or not isinstance(needed, list):
            return [*out, f"{at}: schema is malformed"]
        out += [f"{at}.{k}: missing" for k in sorted(map(str, needed)) if k not in value]
        for k in sorted(value):
            out += faults(value[k], known[k] if k in known else other, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{at}[{i}]")
    return out


def verdict(arguments: str, schema: str | None, declared: bool) -> str:
    """The status of a call's arguments under a schema, both JSON; ``declared``: whether any tool is."""
    if schema is None:
        return "invalid $: unknown tool" if declared else "unchecked"
    try:
        wrong = faults(json.loads(arguments), json.loads(schema))
    except RecursionError:
        wrong = ["$: nested too deep"]
    return "invalid " + "; ".join(wrong) if wrong else "ok"


def spans(text: str):
    """kind, start, end and content of every closed span, leftmost first, in one pass."""
    at, unclosed = 0, set()
    while m := OPEN.search(text, at):
        at, kind = m.end(), m[1]
        if kind in unclosed:
            continue
        close = f"</tool_{kind}>"
        end = text.find(close, at)
        if end < 0:
            unclosed.add(kind)
            continue
        yield kind, m.start(), end + len(close), text[at:end]
        at = end + len(close)


def _item(kind: str, content: str):
    """kind, name, status, after, arguments or schema, and the JSON line of a span."""
    try:
        x = parsed(content)
        if not isinstance(x, dict):
            raise ValueError("no object")
        if kind == "schema":
            if not isinstance(x.get("name"), str) or not isinstance(x.get("parameters"), (dict, bool)):
                raise ValueError("no schema")
            body, line = canonical(x["parameters"]), {"kind": kind, "name": x["name"], "parameters": x["parameters"]}
            return kind, x["name"], None, "ok", [], body, canonical(line)
        if not isinstance(x.get("id"), str):
            raise ValueError("no id")
        if kind == "result":
            return kind, None, x["id"], "ok", [], None, canonical({"content": x.get("content"), "id": x["id"], "kind": kind})
        after = x.get("after")
        after = [] if after is None else after
        if not isinstance(x.get("name"), str) or not isinstance(after, list) or not all(isinstance(a, str) for a in after):
            raise ValueError("no call")
        line = {"arguments": x.get("arguments"), "id": x["id"], "kind": kind, "name": x["name"]}
        return kind, x["name"], x["id"], "ok", sorted(set(after)), canonical(x.get("arguments")), canonical(line)
    except (ValueError, RecursionError):
        return "malformed", None, None, "malformed", [], None, canonical({"content": content, "kind": "malformed"})


def _items(text: str | None, role: str | None):
    """The items of a text; the first is the message itself, without its spans."""
    found, plain, last = [], [], 0
    for kind, start, end, content in spans(text or ""):
        found.append(_item(kind, content))
        plain.append(text[last:start])
        last = end
    plain.append((text or "")[last:])
    return [("message", None, None, "ok", [], None, canonical({"content": "".join(plain), "kind": "message", "role": role})), *found]


ITEMS = "conv_id long, turn long, ord int, kind string, name string, call_id string, status string, after array<string>, body string, json string"


def items(messages: DataFrame) -> DataFrame:
    """One row per message, schema, call and result."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string(), pa.string())
    names = [f.split()[0] for f in ITEMS.split(", ")]

    def run(batches):
        for b, texts in in_slices(batches, "text"):
            rows = []
            for conv, turn, role, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts):
                rows += [(conv, turn, i, *x) for i, x in enumerate(_items(t, role))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, ITEMS)


def _ref(part: str):
    """A key of a conversation and an id within it; never null where the id is not."""
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col(part))


def _firsts(rows: DataFrame, kind: str, by: str) -> DataFrame:
    """ref, at, name, body, after: for each conversation and id (or name), the first row of a kind."""
    mine = rows.filter(F.col("kind") == kind)
    first = mine.groupBy(_ref(by).alias("ref")).agg(F.min(F.struct(F.struct("turn", "ord").alias("at"), "name", "body", "after")).alias("x"))
    return first.select("ref", "x.*")


def _checked(calls: DataFrame, schemas: DataFrame, given: dict) -> DataFrame:
    """ref, verdict of the arguments of calls (ref, name, body), by the schema of their conversation or of ``given``."""
    known = {k: canonical(v) for k, v in given.items()}
    conv = F.substring_index("ref", ":", 1)
    tool = F.concat(conv, F.lit(":"), F.col("name"))
    declared = schemas.select(F.substring_index("ref", ":", 1).alias("d_conv")).distinct()
    rows = calls.select("ref", "name", "body", conv.alias("conv"), tool.alias("tool")).join(schemas.select(F.col("ref").alias("s_ref"), F.col("body").alias("schema")), F.col("tool") == F.col("s_ref"), "left")
    rows = rows.join(declared, F.col("conv") == F.col("d_conv"), "left").select("ref", "name", "body", "schema", F.col("d_conv").isNotNull().alias("declared"))

    def run(batches):
        for b in batches:
            ref, name, body, schema, any_ = (b.column(i).to_pylist() for i in range(5))
            told = [verdict(a, known.get(n) if s is None else s, d or bool(known)) for n, a, s, d in zip(name, body, schema, any_)]
            yield pa.RecordBatch.from_arrays([pa.array(ref, pa.string()), pa.array(told, pa.string())], names=["ref", "verdict"])

    return rows.mapInArrow(run, "ref string, verdict string")


def _levels(calls: DataFrame) -> DataFrame:
    """ref, level (null within or behind a cycle, or behind a call that is not there), lost (whether it waits for such a one)."""
    dep = F.concat(F.substring_index("ref", ":", 1), F.lit(":"), F.col("dep"))
    edges = calls.select("ref", F.explode("after").alias("dep")).select("ref", dep.alias("dep"))
    there = calls.select(F.col("ref").alias("t_ref"))
    waits = stash(edges.join(there, F.col("dep") == F.col("t_ref"), "left"), "chat-waits")
    lost = waits.filter("t_ref is null").select(F.col("ref").alias("l_ref")).distinct().withColumn("lost", F.lit(True))
    left = waits.select("ref", "dep")
    ready = stash(calls.select("ref").join(left.select("ref"), "ref", "left_anti"), "chat-ready")
    levels, level, old = ready.withColumn("level", F.lit(0)), 0, []
    while not left.isEmpty() and not ready.isEmpty():
        level += 1
        met = left.join(ready.select(F.col("ref").alias("r_ref")), F.col("dep") == F.col("r_ref"), "left")
        met = stash(met.select("ref", "dep", F.col("r_ref").isNull().alias("open")), "chat-met")
        still = met.filter("open").select("ref", "dep")
        ready = stash(met.filter("not open").select("ref").distinct().join(still.select("ref"), "ref", "left_anti"), "chat-ready")
        levels = levels.union(ready.withColumn("level", F.lit(level)))
        left = still
        for x in old:
            drop(x)
        old = [met]
    out = calls.select("ref").join(levels.toDF("v_ref", "level"), F.col("ref") == F.col("v_ref"), "left").join(lost, F.col("ref") == F.col("l_ref"), "left")
    return out.select("ref", "level", F.coalesce("lost", F.lit(False)).alias("lost"))


def link(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv_id, turn, ord, kind, call_id, status, place, json of every message, schema, call and result.

    ``place`` is (turn, level, part, ord): rows of a conversation in its order are formatted. ``schemas`` (name to JSON
    schema) hold where a conversation declares none of that name.
    """
    rows = stash(items(messages), "chat-items")
    calls, results, tools = (stash(_firsts(rows, k, by), f"chat-{k}") for k, by in (("call", "call_id"), ("result", "call_id"), ("schema", "name")))
    levels, told = _levels(calls.select("ref", "after")), _checked(calls, tools, schemas or {})
    both = (
        calls.select(F.col("ref").alias("b_ref"), F.col("at").alias("call_at"))
        .join(results.select(F.col("ref").alias("r_ref"), F.col("at").alias("result_at")), F.col("b_ref") == F.col("r_ref"), "full")
        .select(F.coalesce("b_ref", "r_ref").alias("b_ref"), "call_at", "result_at")
        .join(levels.withColumnRenamed("ref", "v_ref"), F.col("b_ref") == F.col("v_ref"), "left")
        .join(told.withColumnRenamed("ref", "t_ref"), F.col("b_ref") == F.col("t_ref"), "left")
        .select("b_ref", "call_at", "result_at", "level", "lost", "verdict", F.lit(None).cast(tools.schema["at"].dataType).alias("tool_at"))
    )
    # schemas go by name, in a space of keys of their own
    named = tools.select(F.concat(F.lit("s"), "ref").alias("b_ref"), *[F.lit(None).cast(both.schema[c].dataType).alias(c) for c in both.columns[1:-1]], F.col("at").alias("tool_at"))
    ref = F.when(F.col("kind") == "schema", F.concat(F.lit("s"), _ref("name"))).otherwise(_ref("call_id"))
    out = rows.withColumn("ref", ref).join(both.union(named), F.col("ref") == F.col("b_ref"), "left")
    kind = F.col("kind")
    mine = F.when(kind == "call", F.col("call_at")).when(kind == "result", F.col("result_at")).otherwise(F.col("tool_at"))
    status = (
        F.when(kind.isin("message", "malformed"), F.col("status"))
        .when(~F.struct("turn", "ord").eqNullSafe(mine), "duplicate")
        .when(kind == "schema", F.col("status"))
        .when((kind == "call") & F.col("verdict").startswith("invalid"), F.col("verdict"))
        .when(F.col("call_at").isNull() | F.col("result_at").isNull(), "unlinked")
        .when(F.col("lost"), "missing")
        .when(F.col("level").isNull(), "cycle")
        .when(kind == "call", F.col("verdict"))
        .otherwise("ok")
    )
    turn = F.when((kind == "result") & F.col("call_at").isNotNull(), F.greatest("turn", "call_at.turn")).otherwise(F.col("turn"))
    part = F.when(kind == "result", 2).when(kind == "call", 1).otherwise(0)
    place = F.struct(turn.alias("turn"), F.coalesce("level", F.lit(0)).alias("level"), part.alias("part"), F.col("ord").alias("ord"))
    return out.select("conv_id", "turn", "ord", "kind", "call_id", status.alias("status"), place.alias("place"), "json")


def formatted(linked: DataFrame) -> DataFrame:
    """The rows of :func:`link` in the order of conversations and places, over partitions in that order."""
    return linked.repartitionByRange("conv_id", "place").sortWithinPartitions("conv_id", "place")


def op7(messages: DataFrame) -> DataFrame:
    return link(messages)
