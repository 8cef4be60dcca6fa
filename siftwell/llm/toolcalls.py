"""Tool calls linked with their results, ordered, validated and serialised as canonical JSON.

Calls and results are joined by conversation and identifier in a shuffled hash join. A call depends on the calls
whose identifiers its arguments reference ({"$ref": id}); within a conversation calls are ordered topologically,
ready calls by turn, then identifier. Arguments are checked against the tool's JSON schema (type, enum, const,
required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength, minItems, maxItems,
uniqueItems). The conversation's record is written as canonical JSON: no white space, keys sorted by UTF-16 code units,
numbers in their shortest form, lone surrogates as escapes.

Statuses: ``linked``; ``unanswered`` (no result); ``ambiguous`` (several results, all listed); ``duplicate`` (an
identifier that more than one call uses; the first by turn and arguments takes the results). Calls on a cycle come
last, by turn and identifier, and are marked; so are those that depend on them.

Defined results: rows with a null conversation are left out; a null identifier links nothing, such a call is
unanswered. A null or unparsable argument text and an unknown tool make a call invalid; a text that isn't JSON, or
that is nested over ``DEPTH`` levels (parsers differ beyond it), is kept as it stands as "text" beside null
arguments. Texts of any length are parsed whole. A reference to no call of the conversation is an error of the
arguments, not a dependency. Results without a call are listed as orphans; an empty content is a result like any
other. Calls and results of one turn are ordered by identifier, name and text, so that no result depends on the
order of rows. Rows that repeat in every column count once. Empty tables give an empty result. Other columns are left
out, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Levels of arrays and objects in each other that are parsed.
DEPTH = 256
STRING = re.compile(r'"(?:[^"\\]|\\.)*+"?', re.S)
BRACKETS = re.compile(r"[][{}]")
LONE = re.compile("[\ud800-\udfff]")


def tool(needed: str, **properties: dict) -> dict:
    return dict(type="object", properties=properties, required=needed.split(), additionalProperties=False)


SCHEMAS = {
    "search": tool("query limit", query=dict(type="string", minLength=1, maxLength=1500), limit=dict(type="integer", minimum=1, maximum=50), after=dict(type="object")),
    "lookup": tool("key scope", key=dict(type="string"), scope=dict(enum=["page", "site", "web"]), of=dict(type="object")),
    "compute": tool("op values", op=dict(enum=["sum", "mean"]), values=dict(type="array", items=dict(type="number"), minItems=1), inputs=dict(type="array", items=dict(type="object"))),
}


def number(x: float) -> str:
    """The shortest form of a finite double, in JavaScript's notation."""
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    d = "".join(map(str, digits))
    point = len(d) + exponent
    if 0 < point <= 21:
        s = d + "0" * (point - len(d)) if point >= len(d) else f"{d[:point]}.{d[point:]}"
    elif -6 < point <= 0:
        s = "0." + "0" * -point + d
    else:
        s = d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + s


def canonical(value) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, str):
        text = json.dumps(value, ensure_ascii=False)
        return text if text.isascii() else LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)
    if isinstance(value, int):
        return str(value) if abs(value) < 2**53 else number(float(value))
    if isinstance(value, float):
        return number(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))) + "}"
    return "[" + ",".join(map(canonical, value)) + "]"


def nested(text: str) -> int:
    """The deepest level of brackets outside strings."""
    if text.count("[") + text.count("{") <= DEPTH:
        return 0
    deepest = level = 0
    for m in BRACKETS.finditer(STRING.sub("", text)):
        level += 1 if m.group() in "[{" else -1
        deepest = max(deepest, level)
    return deepest


def parsed(text: str | None):
    """Strict JSON: no repeated keys, no NaN or infinities."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(x):
        raise ValueError(f"{x} is no JSON")

    def real(x):
        if math.isinf(v := float(x)):
            raise ValueError("number too large")
        return v

    if text is None:
        raise ValueError("no arguments")
    if nested(text) > DEPTH:
        raise ValueError(f"nested over {DEPTH} levels")
    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse, parse_float=real, parse_int=lambda x: int(x) if len(x) < 17 else real(x))


TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
}


def errors(value, schema: dict, at: str = "") -> Iterator[str]:
    """What breaks the schema, each with a JSON pointer."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(TYPES[k](value) for k in kinds):
        yield f"{at}: not {' or '.join(kinds)}"
        return
    same = lambda a, b: canonical(a) == canonical(b)
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        yield f"{at}: not in enum"
    if "const" in schema and not same(value, schema["const"]):
        yield f"{at}: not the constant"
    if TYPES["number"](value):
        if value < schema.get("minimum", value):
            yield f"{at}: below minimum"
        if value > schema.get("maximum", value):
            yield f"{at}: above maximum"
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            if len(value) < schema.get(low, 0):
                yield f"{at}: under {low}"
            if len(value) > schema.get(high, len(value)):
                yield f"{at}: over {high}"
    if isinstance(value, list):
        if schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
            yield f"{at}: items repeat"
        for i, v in enumerate(value):
            yield from errors(v, schema.get("items", {}), f"{at}/{i}")
    if isinstance(value, dict):
        yield from (f"{at}/{k}: missing" for k in schema.get("required", []) if k not in value)
        known = schema.get("properties", {})
        for k, v in value.items():
            if k in known:
                yield from errors(v, known[k], f"{at}/{k}")
            elif schema.get("additionalProperties", True) is False:
                yield f"{at}/{k}: unknown"
            elif isinstance(schema.get("additionalProperties"), dict):
                yield from errors(v, schema["additionalProperties"], f"{at}/{k}")


def references(value) -> Iterator[str]:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if set(v) == {"$ref"} and isinstance(v["$ref"], str):
                yield v["$ref"]
            else:
                todo += v.values()
        elif isinstance(v, list):
            todo += v


def ordered(keys: list[tuple], needs: dict[int, set[int]]) -> tuple[list[int], set[int]]:
    """Kahn's order of the positions, the smallest key first among the ready; and those that no order reaches."""
    after, left = defaultdict(list), {i: len(needs[i]) for i in range(len(keys))}
    for i, on in needs.items():
        for j in on:
            after[j].append(i)
    ready = [(keys[i], i) for i, n in left.items() if not n]
    heapify(ready)
    out = []
    while ready:
        _, i = heappop(ready)
        out.append(i)
        for j in after[i]:
            left[j] -= 1
            if not left[j]:
                heappush(ready, (keys[j], j))
    rest = sorted(set(range(len(keys))) - {*out}, key=lambda i: (keys[i], i))
    return out + rest, {*rest}


def conversation(calls: list[dict], schemas: dict) -> dict:
    """One conversation's calls, with results joined to them, in order."""
    orphans = sorted((r["turn"] or 0, r["content"] or "") for c in calls if c["orphan"] for r in c["results"])
    calls = sorted((c for c in calls if not c["orphan"]), key=lambda c: (c["turn"] or 0, c["call_id"] or "", c["name"] or "", c["arguments"] or ""))
    first: dict[str, int] = {}
    for i, c in enumerate(calls):
        if c["call_id"] is not None:
            first.setdefault(c["call_id"], i)
    items, needs = [], {}
    for i, c in enumerate(calls):
        value, wrong, on, raw = None, [], set(), {}
        try:
            value = parsed(c["arguments"])
        except ValueError as e:
            wrong, raw = [f"not JSON: {e}"], {} if c["arguments"] is None else {"text": c["arguments"]}
        else:
            wrong = [*errors(value, schemas[c["name"]])] if c["name"] in schemas else ["unknown tool"]
            for ref in references(value):
                if ref in first:
                    on.add(first[ref])
                else:
                    wrong.append(f"no call {ref}")
        needs[i] = on
        repeated = c["call_id"] is not None and first[c["call_id"]] != i
        results = [] if repeated else sorted(c["results"], key=lambda r: (r["turn"] or 0, r["content"] or ""))
        status = "duplicate" if repeated else ("unanswered", "linked", "ambiguous")[min(2, len(results))]
        items.append({"id": c["call_id"], "name": c["name"], "turn": c["turn"], "arguments": value, "errors": sorted(wrong), "status": status, "results": [r["content"] for r in results], **raw})
    order, cyclic = ordered([(c["turn"] or 0, c["call_id"] or "") for c in calls], needs)
    for i in cyclic:
        items[i]["cyclic"] = True
    listed = [items[i] for i in order]
    text = canonical({"calls": listed, "orphans": [c for _, c in orphans]})
    count = lambda s: sum(x["status"] == s for x in listed)
    return {"order": [x["id"] for x in listed], "n_calls": len(listed), "n_linked": count("linked"), "n_unanswered": count("unanswered"), "n_ambiguous": count("ambiguous"), "n_duplicate": count("duplicate"), "n_orphans": len(orphans), "n_invalid": sum(bool(x["errors"]) for x in listed), "n_cyclic": len(cyclic), "json": text}


COUNTS = ("n_calls", "n_linked", "n_unanswered", "n_ambiguous", "n_duplicate", "n_orphans", "n_invalid", "n_cyclic")


def link(calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """A row for each conversation, from calls (conv_id, turn, call_id, name, arguments) and results (conv_id, turn, call_id, content)."""
    shared = schemas or SCHEMAS
    own = calls.where("conv_id is not null").select("conv_id", "turn", "call_id", "name", "arguments").distinct()
    answers = results.where("conv_id is not null").select(F.col("conv_id").alias("answer_conv"), F.col("call_id").alias("answer_id"), F.struct(F.col("turn").alias("turn"), "content").alias("r")).distinct().groupBy("answer_conv", "answer_id").agg(F.collect_list("r").alias("results"))
    joined = own.join(answers.hint("shuffle_hash"), (F.col("conv_id") == F.col("answer_conv")) & (F.col("call_id") == F.col("answer_id")), "full_outer")
    conv = F.coalesce("conv_id", "answer_conv")
    rows = joined.select(conv.cast("bigint").alias("conv_id"), F.struct(F.col("turn"), F.col("call_id"), F.col("name"), F.col("arguments"), F.coalesce("results", F.array().cast("array<struct<turn:bigint,content:string>>")).alias("results"), F.col("conv_id").isNull().alias("orphan")).alias("c")).groupBy("conv_id").agg(F.collect_list("c").alias("calls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("call_order", pa.list_(pa.string())), *((c, pa.int32()) for c in COUNTS), ("json", pa.string())])
        for batch in batches:
            out = []
            for conv_id, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = conversation(found.as_py(), shared)
                out.append({"conv_id": conv_id, "call_order": x["order"], **{c: x[c] for c in (*COUNTS, "json")}})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return map_arrow(rows, run, "conv_id bigint, call_order array<string>, " + ", ".join(f"{c} int" for c in COUNTS) + ", json string")


def calls_of(conversations: DataFrame) -> DataFrame:
    """Tool calls made from the assistant's turns, with their whole texts: tool, faults and references follow from the numbers of the turn."""
    turns = conversations.where("role = 'assistant'").withColumn("k", (F.col("conv_id") * 7 + F.col("turn")) % 30)
    name, k = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("compute")), (F.col("k") % 3 + 1).cast("int")), F.col("k")
    call_id = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    ref = F.struct(call_id(F.when(k % 10 == 9, F.col("turn") + 2).otherwise(F.col("turn") - 2)).alias("$ref"))
    some = lambda c, x: F.when(c, x)
    search = F.to_json(F.struct(F.col("text").alias("query"), F.when(k == 6, 0).otherwise(F.length("text") % 50 + 1).alias("limit"), some((F.col("turn") > 2) & (k < 15), ref).alias("after")))
    lookup = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("key"), some(k != 4, F.element_at(F.array(F.lit("page"), F.lit("site"), F.lit("web")), (k % 3 + 1).cast("int"))).alias("scope"), some(k == 7, F.lit(1)).alias("extra"), some(F.col("turn") > 2, ref).alias("of")))
    compute = F.to_json(F.struct(F.when(k == 20, "median").otherwise("sum").alias("op"), F.transform(F.split(F.col("text"), " "), lambda w: F.length(w) / 4).alias("values")))
    text = F.when(k == 29, F.lit('{"op": "sum", "values": [1,')).when(k % 3 == 0, search).when(k % 3 == 1, lookup).otherwise(compute)
    return turns.select("conv_id", "turn", call_id(F.col("turn")).alias("call_id"), name.alias("name"), text.alias("arguments"))


def results_of(conversations: DataFrame) -> DataFrame:
    """Results made from the turns after the assistant's; some are missing, doubled or belong to no call."""
    k = (F.col("conv_id") * 5 + F.col("turn")) % 23
    turns = conversations.where("role = 'user' and turn > 0").withColumn("to", F.explode(F.when(k == 3, F.array()).when(k == 8, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).cast("array<int>")))
    return turns.select("conv_id", "turn", F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.when(k == 15, F.lit("lost")).otherwise((F.col("turn") - 1).cast("string"))).alias("call_id"), F.concat(F.col("to").cast("string"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("content"))
