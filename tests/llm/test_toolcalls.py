from __future__ import annotations

import json
import random

import pytest

from siftwell.llm import toolcalls as tc

CALLS, RESULTS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, results int", "conv_id bigint, turn bigint, call_id string, content string, orphan int"


def call(conv, turn, id_, name="compute", arguments='{"op":"sum","values":[1]}'):
    return conv, turn, id_, name, arguments, 0


def run(spark, calls, results):
    c, r = spark.createDataFrame(calls, CALLS), spark.createDataFrame([(*x, 0) for x in results], RESULTS)
    return {x.conv_id: x for x in tc.link(c, r).collect()}


def test_statuses(spark):
    got = run(spark, [call(1, 1, "a"), call(1, 2, "b"), call(1, 3, "c"), call(1, 4, "a"), call(1, 4, "a"), call(1, 5, None)], [(1, 2, "a", "x"), (1, 3, "b", "y"), (1, 4, "b", "z"), (1, 9, "q", "lost"), (1, 9, "q", "lost"), (1, 9, None, "nobody")])[1]
    assert (got.n_calls, got.n_linked, got.n_ambiguous, got.n_unanswered, got.n_duplicate, got.n_orphans) == (5, 1, 1, 2, 1, 2)
    parsed = json.loads(got.json)
    assert [c["results"] for c in parsed["calls"]] == [["x"], ["y", "z"], [], [], []] and parsed["orphans"] == ["lost", "nobody"]


def test_order_by_references(spark):
    ref = lambda *ids: json.dumps({"op": "sum", "values": [1], "inputs": [{"$ref": i} for i in ids]})
    got = run(spark, [call(1, 1, "a", arguments=ref("c")), call(1, 2, "b"), call(1, 3, "c"), call(2, 1, "x", arguments=ref("y")), call(2, 2, "y", arguments=ref("x")), call(2, 3, "z", arguments=ref("y")), call(2, 4, "w", arguments=ref("gone"))], [])
    assert got[1].call_order == ["b", "c", "a"]
    assert got[2].call_order == ["w", "x", "y", "z"] and got[2].n_cyclic == 3 and got[2].n_invalid == 1


def test_random_orders_respect_references():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 9)
        needs = {i: {j for j in range(n) if r.random() < 0.15} for i in range(n)}
        order, cyclic = tc.ordered([(i,) for i in range(n)], needs)
        assert sorted(order) == list(range(n))
        for i in set(range(n)) - cyclic:
            assert all(order.index(j) < order.index(i) for j in needs[i])
        assert all(needs[i] & cyclic for i in cyclic)


@pytest.mark.parametrize(
    ("value", "text"),
    [(1.0, "1"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.1, "0.1"), (-0.0, "0"), (123456789012345680000.0, "123456789012345680000"), (5e-324, "5e-324"), (True, "true"), ([1, None], "[1,null]"), ({"b": 1, "a": {"é": "€\n"}}, '{"a":{"é":"€\\n"},"b":1}'), ({"דּ": 1, "\U0001f600": 2}, '{"\U0001f600":2,"דּ":1}'), (2**53, "9007199254740992")],
)
def test_canonical_json(value, text):
    assert tc.canonical(value) == text


def test_canonical_form_is_stable():
    r = random.Random(1)

    def make(d=0):
        k = r.randrange(6 if d < 3 else 4)
        return [r.random() * 10 ** r.randrange(-30, 30), r.randrange(-99, 99), None, "".join(chr(r.randrange(1, 0x3000)) for _ in range(3)), None, None][k] if k < 4 else [make(d + 1) for _ in range(3)] if k == 4 else {str(r.randrange(99)): make(d + 1) for _ in range(3)}

    for _ in range(300):
        v = make()
        assert tc.canonical(json.loads(tc.canonical(v))) == tc.canonical(v)


def test_schema_errors():
    s = tc.SCHEMAS["search"]
    ok = {"query": "q", "limit": 3}
    assert not [*tc.errors(ok, s)] and not [*tc.errors(ok | {"limit": 3.0}, s)]
    for bad in ({"limit": 3}, ok | {"x": 1}, ok | {"limit": 0}, ok | {"limit": 51}, ok | {"limit": "3"}, ok | {"limit": True}, ok | {"query": ""}, ok | {"query": "x" * 1501}, [], None):
        assert [*tc.errors(bad, s)], bad
    assert [*tc.errors([1, 1.0], {"uniqueItems": True})] and [*tc.errors(2, {"enum": [1]})] and not [*tc.errors(1.0, {"const": 1})]
    assert [*tc.errors({"a": "x"}, {"additionalProperties": {"type": "number"}})]


@pytest.mark.parametrize("text", [None, "", "{", '{"op":"sum","op":"sum","values":[1]}', "NaN", '{"op":"sum","values":[1e999]}', "[" * 100_000])
def test_bad_arguments_are_invalid(spark, text):
    assert run(spark, [call(1, 1, "a", arguments=text)], [])[1].n_invalid == 1


@pytest.mark.parametrize("depth", [100, 256, 257, 2000, 100_000])
@pytest.mark.parametrize("part", ["[]", '{"a":}'])
def test_deep_arguments(spark, depth, part):
    text = part[:-1] * depth + "1" + part[-1] * depth
    got = run(spark, [call(1, 1, "a", arguments=text)], [(1, 2, "a", "x")])[1]
    item = json.loads(got.json)["calls"][0]
    assert (got.n_invalid, got.n_linked) == (1, 1) and ("text" in item) == (depth > tc.DEPTH)
    assert depth <= tc.DEPTH or item["text"] == text


def test_brackets_in_strings_are_no_levels():
    assert tc.parsed(json.dumps(["[" * 5000, '"{' * 5000, "\\["])) == ["[" * 5000, '"{' * 5000, "\\["]


def test_lone_surrogates(spark):
    low = "\\ud800"
    texts = [f'{{"op":"sum","values":[1],"{low}":1}}', f'{{"query":"{low}x","limit":1}}', f'{{"op":"sum","values":[1],"inputs":[{{"$ref":"{low}"}}]}}', f'"{low}', low]
    got = run(spark, [call(1, i, f"c{i}", "search" if "query" in t else "compute", t) for i, t in enumerate(texts)], [])[1]
    items = json.loads(got.json)["calls"]
    assert got.n_calls == 5 and got.n_invalid == 4 and items[1]["errors"] == [] and items[1]["arguments"]["query"] == "\ud800x"
    assert "no call \ud800" in items[2]["errors"] and items[0]["errors"] == ["/\ud800: unknown"]
    assert tc.canonical("\ud83d\ude00 \udc00") == '"\\ud83d\\ude00 \\udc00"' and tc.canonical("\U0001f600") == '"\U0001f600"'


def slowly(calls, results):
    """Every conversation's statuses, orphans and order by trying all: a plain reading of the rules."""
    calls = sorted({c[:5] for c in calls if c[0] is not None}, key=lambda c: (c[0], c[1], c[2] or "", c[3] or "", c[4] or ""))
    results = {r for r in results if r[0] is not None}
    out = {}
    for conv in {x[0] for x in [*calls, *results]}:
        own, answers = [c for c in calls if c[0] == conv], [r for r in results if r[0] == conv]
        status, needs = [], []
        for i, c in enumerate(own):
            if c[2] is not None and any(d[2] == c[2] for d in own[:i]):
                status.append("duplicate")
            else:
                status.append(("unanswered", "linked", "ambiguous")[min(2, sum(r[2] == c[2] is not None for r in answers))])
            wanted = [x["$ref"] for x in json.loads(c[4]).get("inputs", [])]
            needs.append({next(j for j, d in enumerate(own) if d[2] == w) for w in wanted if any(d[2] == w for d in own)})
        order: list[int] = []
        while free := [i for i in range(len(own)) if i not in order and needs[i] <= {*order}]:
            order.append(min(free, key=lambda i: (own[i][1], own[i][2] or "", i)))
        order += [i for i in range(len(own)) if i not in order]
        orphans = [r[3] for r in sorted(answers, key=lambda r: (r[1], r[3])) if r[2] is None or all(r[2] != c[2] for c in own)]
        out[conv] = ([own[i][2] for i in order], [status[i] for i in order], orphans)
    return out


def test_links_equal_brute_force(spark):
    r = random.Random(6)
    calls, results = [], []
    for conv in range(60):
        ids = [f"i{k}" for k in range(r.randrange(1, 6))] + [None]
        for _ in range(r.randrange(0, 9)):
            refs = [{"$ref": r.choice([i for i in ids if i] + ["gone"])} for _ in range(r.randrange(3))]
            calls.append((conv, r.randrange(5), r.choice(ids), "compute", json.dumps({"op": "sum", "values": [r.randrange(3)], "inputs": refs}), 0))
        for _ in range(r.randrange(0, 6)):
            results.append((conv, r.randrange(9), r.choice([*ids, "lost"]), f"r{r.randrange(4)}"))
    got = run(spark, calls, results)
    want = slowly(calls, results)
    assert set(got) == set(want)
    for conv, (order, status, orphans) in want.items():
        record = json.loads(got[conv].json)
        assert (got[conv].call_order, [c["status"] for c in record["calls"]], record["orphans"]) == (order, status, orphans), conv


def test_calls_hold_whole_texts(tables):
    turns = {(r.conv_id, r.turn): r.text for r in tables("conversations").collect()}
    seen = 0
    for r in tc.calls_of(tables("conversations")).collect():
        if r.arguments and r.name != "compute" and r.arguments.endswith("}"):
            a = json.loads(r.arguments)
            assert a.get("query", a.get("key")) == turns[r.conv_id, r.turn]
            seen += 1
    assert seen


def test_odd_rows(spark):
    got = run(spark, [call(None, 1, "a"), call(1, None, "a", None, None), call(2, 1, "b", "search", json.dumps({"query": "x" * 2_000_000, "limit": 1}))], [(None, 1, "a", "x"), (1, None, "a", None), (3, 1, "c", "only a result")])
    assert set(got) == {1, 2, 3} and got[1].n_linked == 1 and got[2].n_invalid == 1 and (got[3].n_calls, got[3].n_orphans) == (0, 1)
    assert run(spark, [], []) == {}


def test_order_of_rows_does_not_matter(spark, tables):
    turns = tables("conversations")
    a = {r.conv_id: r.json for r in tc.link(tc.calls_of(turns), tc.results_of(turns)).collect()}
    b = {r.conv_id: r.json for r in tc.link(tc.calls_of(turns).repartition(5), tc.results_of(turns).repartition(3)).collect()}
    assert a == b and a
