from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwell.operators import content, documents, evaluation, evidence, ledger, policy, selection


def test_evaluation_example(spark):
    cases = spark.createDataFrame([("a", "x,y", "y", "x,x", "x|x,z", 5, 1), ("b", "", "", "q", None, -1, 2), ("c", "k", "", None, None, 3, 3)], "id string, expected string, high string, reported string, repeats string, latency_ms int, input_tokens int")
    r = {x.id: x for x in evaluation.case_results(cases).collect()}
    assert (r["a"].missing, r["a"].unexpected, r["a"].duplicates, r["a"].outcome, r["a"].stable, r["a"].compared) == (["y"], [], 1, "partial", 1, 2)
    assert (r["b"].outcome, r["c"].outcome) == ("false_positive", "missed")
    m = evaluation.metrics(evaluation.case_results(cases)).first()
    assert (m.true_positives, m.false_positives, m.false_negatives, m.precision, m.duplicate_rate, m.stability, m.false_positive_rate, m.high_severity_misses, m.gate) == (1, 1, 2, 0.5, 1 / 3, 0.5, 1.0, 1, "BLOCK")
    assert tuple(evaluation.resources(cases).first()) == (5, 3)


def test_evaluation_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, expected string, high string, reported string, repeats string")
    m = evaluation.metrics(evaluation.case_results(empty)).first()
    assert (m.precision, m.recall, m.false_positive_rate, m.duplicate_rate, m.stability, m.gate) == (1.0, 1.0, 0.0, 0.0, 1.0, "PASS")


def test_path_classes(spark):
    want = {"src/a.ts": None, ".git/x": "git_metadata", "a/.git/b": "git_metadata", "x/node_modules/y.js": "dependency", "x/build/node_modules/a": "dependency", "a/dist/b.js": "generated", "__pycache__/m.py": "cache", "a/.ENV.local": "suspected_secret", "k/id_rsa": "suspected_secret", "a/b.PNG": "binary", "distance/a.ts": None, "png": None}
    rows = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.c for r in rows.select("path", content.path_class(F.col("path")).alias("c")).collect()} == want


def test_valid_paths(spark):
    want = {"a/b": True, "": False, "/a": False, "a//b": False, "./a": False, "a/..": False, "a\0b": False, "é" * 2048: True, "é" * 2049: False}
    rows = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.v for r in rows.select("path", content.valid_path(F.col("path")).alias("v")).collect()} == want


def test_binary_and_secret_content(spark):
    rows = spark.createDataFrame([(1, bytearray(b"plain\ttext\n")), (2, bytearray(b"a\0b")), (3, bytearray([1] * 4 + [65] * 6)), (4, bytearray([1] * 3 + [65] * 7)), (5, bytearray()), (6, bytearray(b"a" * 8192 + b"\0")), (7, bytearray(b"\xff\xfe"))], "id int, c binary")
    assert [r.b for r in rows.select("id", content.is_binary(F.col("c")).alias("b")).orderBy("id").collect()] == [False, True, True, False, False, False, False]
    assert not rows.where("id = 7").select(content.valid_utf8(F.col("c")).alias("v")).first().v
    texts = {"-----BEGIN PRIVATE KEY-----": True, "-----BEGIN OPENSSH PRIVATE KEY-----": True, "Api-Key = 'abcdefghijklmnop'": True, "token: abcdefghijklmno": False, "tokens abcdefghijklmnopq": False}
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    assert {r.t: r.s for r in t.select("t", content.looks_secret(F.col("t")).alias("s")).collect()} == texts


def test_routing(spark):
    def plan(*paths):
        d = spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)], "review int, ordinal int, path string")
        return content.stages(content.risk_signals(d, "review")).first().stages

    base = content.MANDATORY
    assert plan("a.txt") == base
    assert plan("src/auth.ts", "db/migration.sql") == [*base, "security", "permissions"]
    assert plan("db/schema.ts", "x/queue.ts", "y/redis.ts") == [*base, "data", "cache"]
    assert plan("b.tsx", "a.ts") == base and plan("a.ts", "b.tsx") == [*base, "ui"]


def test_plan_needs_a_specialist(spark):
    d = spark.createDataFrame([(1, content.MANDATORY), (2, [*content.MANDATORY, "permissions"])], "review int, stages array<string>")
    got = {(r.review, r.major_id): r.stage for r in content.assessment_plan(d, "review").collect()}
    assert got[1, "security"] is None and got[2, "security"] == "permissions" and got[1, "compatibility"] == "universal"


def test_later_smaller_file_still_fits(spark):
    d = spark.createDataFrame([("w", 1, 60, None), ("w", 2, 70, None), ("w", 3, 30, None), ("w", 4, 5, "binary"), ("w", 5, 20, None), ("w", 6, 1, None)], "workspace string, ordinal bigint, size bigint, reason string")
    got = [r.outcome for r in selection.greedy_capture(d, max_files=6, max_file_bytes=65, max_bytes=100).orderBy("ordinal").collect()]
    assert got == ["kept", "aggregate_byte_limit", "kept", "binary", "aggregate_byte_limit", "kept"]


def test_context_cuts_the_last_file(spark):
    d = spark.createDataFrame([("w", 1, 60), ("w", 2, None), ("w", 3, 70), ("w", 4, 1)], "workspace string, ordinal bigint, size bigint")
    assert [(r.taken, r.truncated) for r in selection.context(d, max_file_bytes=65, max_bytes=100).orderBy("ordinal").collect()] == [(60, False), (None, False), (40, True), (None, False)]


def test_eviction(spark):
    d = spark.createDataFrame([("w", i, i, i == 9) for i in range(1, 11)], "w string, ordinal bigint, age bigint, artifact boolean")
    assert {r.ordinal for r in selection.eviction(d, "w", 8).collect()} == {9, 1, 2}
    assert {r.ordinal for r in selection.eviction(d, "w", 99).collect()} == {9}
    assert selection.eviction(d, "w", 1, max_removals=4).count() == 4


def test_eviction_for_an_incoming_entry(spark):
    d = spark.createDataFrame([("w", i, i, i == 9) for i in range(1, 11)], "w string, ordinal bigint, age bigint, artifact boolean")
    late, early = (spark.createDataFrame([("w", x)], "w string, incoming_age bigint") for x in (99, 2))
    assert {r.ordinal for r in selection.eviction(d, "w", 8, incoming=late).collect()} == {9, 1, 2} and {r.ordinal for r in selection.eviction(d, "w", 8, incoming=early).collect()} == {9, 1}
    assert [tuple(r) for r in selection.run_capacity(d, "w", 8, late).collect()] == [("w", 3, True)] and [tuple(r) for r in selection.run_capacity(d, "w", 8, early).collect()] == [("w", 2, False)]


def test_folds_of_many_groups(spark):
    rows = [(f"w{g}" if g else None, i, 10 + (i * 7 + g) % 30, None) for g in range(40) for i in range(60)]
    d = spark.createDataFrame(rows, "workspace string, ordinal bigint, size bigint, reason string").repartition(7)
    got = {(r.workspace, r.ordinal): r.outcome for r in selection.greedy_capture(d, max_files=50, max_file_bytes=35, max_bytes=300).collect()}
    for g in range(40):
        used = 0
        for i in range(60):
            size, left = 10 + (i * 7 + g) % 30, 300 - used
            want = "file_limit" if i >= 50 else "aggregate_byte_limit" if left < 1 else ("file_limit" if left >= 35 else "aggregate_byte_limit") if size > min(left, 35) else "kept"
            used += size * (want == "kept")
            assert got[f"w{g}" if g else None, i] == want


def test_diagnostic_gates(spark):
    rows = [(1, "X_LIMIT_EXCEEDED"), (1, "BAD"), (2, "CONFIG_READ_FAILED"), (3, "BAD")]
    d = spark.createDataFrame(rows, "run int, code string")
    got = {r.run: (r.gate, r.invalid) for r in policy.diagnostics_status(d, "run", spark.createDataFrame([(i,) for i in range(1, 5)], "run int")).collect()}
    assert got == {1: ("BLOCK", True), 2: ("INCOMPLETE", False), 3: ("BLOCK", True), 4: ("PASS", False)}


def test_publication_scopes(spark):
    mark = lambda scope, sha="s", h="h": f"<!-- report:{scope}:{sha}:{h} -->"
    comments = spark.createDataFrame([(9, "hello\r\n" + mark("g:o/a:1") + "\r\nx"), (10, mark("g:o/a:10")), (3, mark("g:o/a:1", "old")), (4, "x " + mark("g:o/b:1")), (5, mark("g:o/c:1", "old") + "\n" + mark("g:o/b:1")), (6, mark("g:o/d:1") + " ")], "comment_id bigint, body string")
    wanted = spark.createDataFrame([(f"g:o/{x}:1", "s", "h") for x in "abcd"], "scope string, head_sha string, report_hash string")
    assert {r.scope: (r.action, r.comment_id) for r in policy.publication_action(comments, wanted).collect()} == {"g:o/a:1": ("reused", 9), "g:o/b:1": ("created", None), "g:o/c:1": ("updated", 5), "g:o/d:1": ("created", None)}


def test_diagnostics_limits(spark):
    d = spark.createDataFrame([(1, i, f"p{9 - i}", "C") for i in range(5)], "run int, arrival int, path string, code string")
    assert [(r.path, r.code) for r in selection.bounded_diagnostics(d, "run", 3).orderBy("ordinal").collect()] == [("p5", "C"), ("p6", "C"), (".", "DIAGNOSTIC_LIMIT_EXCEEDED")]
    assert [r.path for r in selection.arrival_diagnostics(d, "run", 3).orderBy("ordinal").collect()] == ["p8", "p9", "."]
    assert selection.bounded_diagnostics(d, "run", 5).where("path = '.'").count() == 0


def test_waiver_paths(spark):
    want = {("src/**", "src/a/b"): True, ("src/**", "src"): True, ("src/*", "src/a/b"): False, ("src/*", "src/a"): True, ("./src/a", "src/a"): True, ("src\\*", "src/a"): True, ("src/**", "../src/a"): False, ("/src/**", "/src/a"): False, ("src/**", "srcx/a"): False}
    d = spark.createDataFrame([*want], "p string, c string")
    assert {(r.p, r.c): r.m for r in d.select("p", "c", policy.path_matches(F.col("p"), F.col("c")).alias("m")).collect()} == want


def test_overlay_and_safety(spark):
    d = spark.createDataFrame([(1, "/a", "1", 1, "base"), (1, "/a", "9", 5, "call"), (1, "/b", "7", 1, "base")], "id int, pointer string, value string, precedence int, source string")
    assert {tuple(r) for r in policy.safe(policy.overlay(d, "id"), {"/a": 2}).collect()} == {(1, "/a", "2", "safety-invariants"), (1, "/b", "7", "base")}


def test_patch_quirks(spark):
    diff = """--- "a/x\\303\\251.ts"
+++ /dev/null
@@ -3 +0,0 @@
-one
--- two
\\ No newline"""
    rows = evidence.diff_lines(spark.createDataFrame([(1, diff), (2, ""), (3, None)], "patch_id int, diff string")).collect()
    assert [(r.side, r.path, r.line, r.content, r.changed) for r in rows] == [("old", "xé.ts", 3, "one", True)]


def test_markdown_blocks(spark):
    text = "# Head #\n\nfirst line\nsecond [a](b.md)\n```\ncode [x](y)\n```\n"
    rows = documents.blocks(spark.createDataFrame([("p", text), ("q", None), ("r", "")], "path string, content string")).orderBy("ordinal").collect()
    assert [(r.kind, r.level, r.text, r.target) for r in rows] == [("heading", 1, "Head", None), ("paragraph", None, "first line second [a](b.md)", None), ("link", None, "a", "b.md"), ("code", None, "code [x](y)", None)]


def test_copied_blocks(spark):
    long = "An instruction that is long enough to count as a block of its own, because it has well over one hundred and twenty characters."
    peers = spark.createDataFrame([("a", 0, "short"), ("a", 3, "  " + long.upper()), ("a", 5, long), ("b", 0, "other " * 40)], "path string, ordinal int, text string")
    own = spark.createDataFrame([("c", 0, long)], "path string, ordinal int, text string")
    assert [(r.path, r.ordinal) for r in documents.copied_blocks(peers, own).collect()] == [("a", 3)]


def test_cycles(spark):
    d = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 8), (None, 1)], "src int, dst int")
    assert {tuple(r) for r in documents.cycles(d).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6)}
    assert documents.cycles(d.where("src > 90")).count() == 0


def test_cycles_of_random_graphs(spark):
    import random

    r = random.Random(3)
    for n, m in ((12, 20), (40, 60), (30, 200)):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(n + i, n + (i + 1) % 9) for i in range(9)}
        reach = {x: {b for a, b in edges if a == x} for x in {y for e in edges for y in e}}
        while any(not s >= {z for y in s for z in reach[y]} for s in reach.values()):
            reach = {x: s | {z for y in s for z in reach[y]} for x, s in reach.items()}
        want = {(x, min(y for y in s if x in reach[y])) for x, s in reach.items() if x in s}
        assert {tuple(x) for x in documents.cycles(spark.createDataFrame([*edges], "src int, dst int")).collect()} == want


def test_cycles_in_blocks(spark):
    import random

    r = random.Random(5)
    for n, m, near in ((60, 90, 6), (80, 100, 80)):
        edges = {(a, min(max(a + r.randrange(-near, near + 1), 0), n - 1)) for a in (r.randrange(n) for _ in range(m))}
        reach = {x: {b for a, b in edges if a == x} for x in {y for e in edges for y in e}}
        while any(not s >= {z for y in s for z in reach[y]} for s in reach.values()):
            reach = {x: s | {z for y in s for z in reach[y]} for x, s in reach.items()}
        want = {(f"{x:03}", f"{min(y for y in s if x in reach[y]):03}") for x, s in reach.items() if x in s}
        d = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in edges], "src string, dst string")
        for most in (1000, 40):
            got = [tuple(x) for x in documents.cycles(d, most).collect()]
            assert len(got) == len(want) and set(got) == want
        live = spark.createDataFrame([*edges], "src long, dst long")
        for most in (0, 20):
            parts = {}
            for x in documents.coloured(live.where("src != dst"), most).collect():
                parts.setdefault(x.component, set()).add(x.node)
            assert sorted(map(sorted, parts.values())) == sorted(p for p in (sorted(int(x) for x, c in want if c == k) for k in {c for _, c in want}) if len(p) > 1)


@pytest.mark.parametrize("most", [documents.EDGES_PER_TASK, 30])
def test_cycles_on_a_long_chain_take_few_jobs(spark, most):
    """A chain of small cycles: rounds along it, or one for each of them, would be hundreds of jobs."""
    edges = [(3 * i + a, 3 * i + b) for i in range(15) for a, b in ((0, 1), (1, 0), (1, 2), (2, 3))]
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {tuple(x) for x in documents.cycles(spark.createDataFrame(edges, "src int, dst int"), most).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(3 * i + k, 3 * i) for i in range(15) for k in (0, 1)}
    assert jobs < 150


def test_components_and_shortcuts():
    import random

    import numpy as np

    from siftwell.functions.graphs import components, shortcuts

    r = random.Random(7)
    for n, m in ((1, 1), (12, 20), (30, 60), (40, 45)):
        for _ in range(5):
            src, dst = (np.array([r.randrange(n) for _ in range(m)], dtype=np.int64) for _ in "ab")
            reach = {x: {b for a, b in zip(src.tolist(), dst.tolist()) if a == x} for x in {*src.tolist(), *dst.tolist()}}
            while any(not s >= {z for y in s for z in reach[y]} for s in reach.values()):
                reach = {x: s | {z for y in s for z in reach[y]} for x, s in reach.items()}
            node, component, cyclic = (x.tolist() for x in components(src, dst))
            of = dict(zip(node, component))
            assert node == sorted(reach) and [x for x, c in zip(node, cyclic) if c] == [x for x in node if x in reach[x]]
            assert all((of[x] == of[y]) == (x == y or (y in reach[x] and x in reach[y])) for x in node for y in node)
            assert all(of[a] >= of[b] for a, b in zip(src.tolist(), dst.tolist()))
            edges = {(of[a], of[b]) for a, b in zip(src.tolist(), dst.tolist()) if of[a] != of[b]}
            far = {(of[a], of[b]) for a, s in reach.items() for b in s if of[a] != of[b]}
            entries, exits = ({of[r.choice(node)] for _ in range(k)} for k in r.choice([(1, 4), (4, 1), (2, 2)]))
            got = shortcuts(edges, entries, exits)
            assert got == edges if len(entries) * len(exits) > len(edges) else got == {(a, b) for a, b in far if a in entries and b in exits}
    assert [len(x) for x in components(np.array([], dtype=np.int64), np.array([], dtype=np.int64))] == [0, 0, 0]


def test_hashes_do_not_depend_on_order(spark):
    d = spark.createDataFrame([("w", "b", "2"), ("w", "a", "1")], "w string, path string, content string")
    assert ledger.snapshot_hash(d, "w").first() == ledger.snapshot_hash(d.orderBy("path"), "w").first()
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert ledger.snapshot_hash(d, "w").first().hash == h(f"1:a={h('1')}\n1:b={h('2')}")


def test_strongest_gate_and_exit(spark):
    d = spark.createDataFrame([(1, "WARN"), (1, "INCOMPLETE"), (2, "BLOCK"), (2, "INCOMPLETE"), (3, "PASS")], "id int, gate string")
    assert {r.id: (r.gate, r.exit_code) for r in policy.exit_code(policy.strongest_gate(d, "id")).collect()} == {1: ("INCOMPLETE", 3), 2: ("BLOCK", 1), 3: ("PASS", 0)}
