"""Captures, forges, stage answers, documents that come in and go out, instructions: cases that tables don't reach."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions import schema
from siftwell.operators import evidence, inputs, instructions, policy, reports, stage_output
from siftwell.plans.relations import MODEL
from siftwell.sources import captures, forges

SHA = "a" * 40


def head(status: str) -> str:
    return f":100644 100644 {SHA} {SHA} {status}\0"


@pytest.mark.parametrize(
    ("raw", "stat", "want"),
    [
        (head("R090") + "a\0b\0", "1\t2\t\0a\0b\0", [("b", "a", "renamed", False, 1, 2)]), (head("C") + "a\0b\0", "-\t-\t\0a\0b\0", [("b", "a", "copied", True, None, None)]), (head("T") + "x y\0", "0\t0\tx y\0", [("x y", None, "type_changed", False, 0, 0)]), ("", "", []),
        (head("M") + "a", "1\t1\ta\0", "not_terminated"), (head("M") + "a\0", "", "unmatched"), ("", "1\t1\ta\0", "residual"), (head("X") + "a\0", "1\t1\ta\0", "status"), ("oops\0a\0", "1\t1\ta\0", "raw"), (head("M") + "a\0" + head("M") + "a\0", "1\t1\ta\0", "raw_duplicate"),
        (head("M") + "a\0", "1\t-\ta\0", "numstat_binary"), (head("M") + "a\0", "1\tx\ta\0", "numstat_count"), (head("M") + "a\0", "1 1 a\0", "numstat"), (head("M") + "a\0", "1\t1\ta\0" * 2, "numstat_duplicate"), (head("R") + "a\0b\0", "1\t1\tb\0", "rename_paths"), (head("M") + "b\0", "1\t1\t\0a\0b\0", "rename_paths"), (head("R") + "a\0b\0", "1\t1\t\0a\0", "numstat_rename"),
    ],
)
def test_git_records(raw, stat, want):
    try:
        got = [r[:6] for r in captures.changed(raw.encode(), stat.encode())]
    except captures.Malformed as e:
        got = str(e)
    assert got == want


def test_envelopes():
    raw, stat = head("M") + "a\0" + head("R1") + "b\0c\0", "1\t1\ta\0" + "2\t0\t\0b\0c\0"
    out = (raw + stat + "\0diff --git a/a b/a\n@@").encode()
    assert captures.split_envelope(out) == (raw.encode(), stat.encode(), b"diff --git a/a b/a\n@@") and captures.split_envelope(b"") == (b"", b"", b"")
    with pytest.raises(captures.Malformed, match="no_boundary"):
        captures.split_envelope(raw.encode())


def test_captures_as_rows(spark):
    rows = [(1, head("M") + "a\0", "1\t1\ta\0"), (2, "x", ""), (3, None, None), (None, head("A") + "é\0", "1\t0\té\0")]
    got = {r.capture_id: r for r in captures.snapshot_files(spark.createDataFrame(rows, "capture_id int, raw string, numstat string")).collect()}
    assert set(got) == {1, 2, None} and got[2].issue == "not_terminated" and got[None].path == "é" and got[1].new_object == SHA


def test_order_of_paths(spark):
    d = spark.createDataFrame([(1, p, None) for p in ("\U0001f600", "\ufb33", "b", "a/b")], "c int, path string, previous_path string")
    assert [r.path for r in captures.ordered_files(d, "c").orderBy("ordinal").collect()] == ["a/b", "b", "\U0001f600", "\ufb33"]


def test_addresses(spark):
    want = {
        "https://github.com/o/r/pull/5": ("github", "o", "r", 5, None), "HTTPS://GitHub.com/o/r/pull/5/": ("github", "o", "r", 5, None), "https://gitlab.com/g/p/merge_requests/7": ("gitlab", "g", "p", 7, None), "https://gitlab.com/p/-/merge_requests/7": (None, None, None, None, "project"),
        "https://github.com/o/r/pull/5/files": (None, None, None, None, "shape"), "https://u:p@github.com/o/r/pull/5": (None, None, None, None, "userinfo"), "https://github.com:443/o/r/pull/5": ("github", "o", "r", 5, None), "https://github.com/o/r/pull/99999999999999999": (None, None, None, None, "number"), "nothing": (None, None, None, None, "invalid"), None: (None, None, None, None, "invalid"),
    }
    d = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: (r.kind, r.owner, r.repository, r.number, r.issue) for r in forges.address(d).collect()} == want


def test_merge_requests(spark):
    changes = {"changes": [{"new_path": "a", "diff": "x"}] * 199 + [{"old_path": ""}] + [{"new_path": "late"}]}
    d = spark.createDataFrame([(1, json.dumps(changes)), (2, "{}"), (3, None)], "change_id int, body string")
    rows = forges.merge_request_files(d).collect()
    assert len(rows) == 199 and all(r.incomplete and r.path == "a" for r in rows)
    assert {r.change_id: r.diff for r in forges.merge_request_diff(d).collect()} == {1: "\n".join("x" * 50), 2: None, 3: None}
    body = {"title": "t", "diff_refs": {"base_sha": SHA, "head_sha": SHA}, "source_project_id": 1, "target_project_id": 2}
    r = forges.revisions(spark.createDataFrame([(1, json.dumps(body)), (2, '{"diff_refs":{"base_sha":"x"}}')], "change_id int, body string")).orderBy("change_id").collect()
    assert (r[0].issue, r[0].forked, r[1].issue) == (None, True, "revisions")


GOOD = {"title": "T", "severity": "P1", "evidence": "long enough text", "path": "a", "startLine": 1, "endLine": 2, "sourceQuote": "12345678"}
SCORED = {"minorId": "m", "status": "scored", "rating": 2.5, "confidence": "low", "evidence": [{"path": "a", "startLine": 1, "endLine": 1, "sourceQuote": "12345678"}], "explanation": "e"}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({"candidates": []}, None), ({"candidates": [GOOD], "assessments": [SCORED, {"minorId": "m", "status": "not_applicable", "reason": "r"}]}, None), ({}, ("", "required")), ([], ("", "type")), ({"candidates": [], "x": 1}, ("", "additionalProperties")), ({"candidates": [GOOD] * 65}, ("/candidates", "maxItems")),
        ({"candidates": [{k: v for k, v in GOOD.items() if k != "sourceQuote"}]}, ("/candidates/0", "required")), ({"candidates": [GOOD | {"startLine": True}]}, ("/candidates/0/startLine", "type")), ({"candidates": [GOOD | {"endLine": 2.0}]}, None), ({"candidates": [GOOD | {"title": "😀" * 300}]}, None), ({"candidates": [GOOD | {"title": "x" * 301}]}, ("/candidates/0/title", "maxLength")),
        ({"candidates": [], "assessments": [SCORED | {"rating": 2.3}]}, ("/assessments/0/rating", "multipleOf")), ({"candidates": [], "assessments": [SCORED | {"rating": 5.5}]}, ("/assessments/0/rating", "maximum")), ({"candidates": [], "assessments": [SCORED | {"evidence": []}]}, ("/assessments/0/evidence", "minItems")), ({"candidates": [], "assessments": [SCORED | {"explanation": " \n"}]}, ("/assessments/0/explanation", "pattern")),
        ({"candidates": [], "assessments": [{"minorId": "m", "status": "not_applicable", "reason": ""}]}, ("/assessments/0", "required")),
    ],
)
def test_stage_answers(value, want):
    assert schema.fault(value, stage_output.answer()) == want


def test_stage_answers_as_rows(spark):
    d = spark.createDataFrame([("a", json.dumps({"candidates": [GOOD], "assessments": [SCORED]})), ("b", "{"), ("c", None), ("d", "[" * 100_000)], "stage_id string, content string")
    got = {r.stage_id: (r.ok, r.path, r.keyword) for r in stage_output.validated(d).collect()}
    assert got == {"a": (True, None, None), **{k: (False, "/", "type") for k in "bcd"}}
    a = stage_output.assessments(d.where("stage_id = 'a'")).first()
    assert (a.half_points, a.n_evidence, a.text) == (5, 1, "e") and stage_output.candidates(d.where("stage_id = 'a'")).first().quote == "12345678"


def model(**changes):
    minor = lambda m, w: {"id": m, "name": m, "weightTenths": w, "required": True, "domainVocabulary": [m], "ratingAnchors": {f"{k}.0": f"anchor number {k} of the minor {m}, spelled out" for k in range(6)}}
    whole = {"id": "m", "version": "1", "roundingMode": "half_up", "ruleVersions": {}, "majors": [{"id": j, "name": j, "weightTenths": w, "minors": [minor(m, x) for m, x in minors]} for j, w, minors in MODEL]}
    return whole | changes


def changed(i, k, **fields):
    m = model()
    target = m["majors"][i] if k is None else m["majors"][i]["minors"][k]
    target.update(fields)
    return m


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (model(), []), (None, ["INVALID_DOCUMENT_STRUCTURE"]), (model(id=3), ["INVALID_DOCUMENT_STRUCTURE"]), (model(id=" "), ["INVALID_MODEL_ID"]), (model(version=""), ["INVALID_MODEL_VERSION"]), (model(profileHash=""), ["INVALID_PROFILE_HASH"]), (model(roundingMode="up"), ["INVALID_ROUNDING_MODE"]),
        (model(majors=[]), ["MAJOR_SET_INVALID", "MAJOR_TOTAL_INVALID"]), (model(majors=model()["majors"] * 2), ["MODEL_LIMIT_EXCEEDED"]), (changed(0, None, minors=model()["majors"][0]["minors"] * 26), ["MODEL_LIMIT_EXCEEDED"]),
        (changed(1, None, id=MODEL[0][0]), ["DUPLICATE_MAJOR_ID", "MAJOR_SET_INVALID"]), (changed(0, None, name=" "), ["UNNAMED_MAJOR"]), (changed(0, None, weightTenths=200.5), ["INVALID_MAJOR_WEIGHT", "MINOR_TOTAL_MISMATCH", "MAJOR_TOTAL_INVALID"]), (changed(0, 1, id=MODEL[0][2][0][0]), ["DUPLICATE_MINOR_ID"]), (changed(0, 0, name=""), ["UNNAMED_MINOR"]),
        (changed(0, 0, weightTenths=-40), ["INVALID_MINOR_WEIGHT", "MINOR_TOTAL_MISMATCH"]), (changed(0, 0, domainVocabulary=["todo"]), ["INVALID_DOMAIN_VOCABULARY"]), (changed(0, 0, domainVocabulary=["abc", "ＡＢＣ"]), ["INVALID_DOMAIN_VOCABULARY"]), (changed(0, 0, ratingAnchors={}), ["INVALID_RATING_ANCHORS"]), (changed(0, 0, domainVocabulary=["other words"]), ["INVALID_RATING_ANCHORS"]),
    ],
)
def test_model_issues(value, want):
    assert [c for c, _ in inputs.model_faults(value)] == want


def test_model_issues_as_rows(spark):
    d = spark.createDataFrame([("a", json.dumps(model())), ("b", json.dumps(changed(2, 1, name=""))), ("c", "{"), ("d", None)], "path string, content string")
    assert {(r.path, r.code, r.at) for r in inputs.model_issues(d).collect()} == {("b", "UNNAMED_MINOR", "majors[2].minors[1].name"), ("c", "INVALID_DOCUMENT_STRUCTURE", ""), ("d", "INVALID_DOCUMENT_STRUCTURE", "")}


def test_score_inputs_with_models():
    context = {"scope": "change", "gate": "PASS"}
    base = {"assessments": [], "context": context}
    issue = lambda v: inputs.score_input(json.dumps(v))[0]
    assert issue(base | {"schemaVersion": "1", "model": model(), "baseline": base}) is None
    assert issue(base | {"model": model(id="")}) == "model" and issue(base | {"model": None}) == "model" and issue(base | {"baseline": base | {"baseline": base}}) == "keys" and issue(base | {"baseline": base | {"context": {}}}) == "keys"
    assert issue({"context": context}) == "keys" and issue([]) == "keys" and inputs.score_input("{")[0] == "keys" and inputs.score_input(None)[0] == "keys"
    assert issue(base | {"context": context | {"focusedDomainId": None}}) == "context" and issue(base | {"context": context | {"blockingFindings": [{"id": "x" * 257, "confirmed": True, "blocking": True}]}}) == "blocking"


CASE = {"id": "c-1", "domain": "d", "runner": "external", "fixture": "f/a.ts", "expectedFindingIds": ["A", "B"], "highSeverityFindingIds": ["A"]}


def test_manifests(spark):
    root = lambda *cases, **more: {"schemaVersion": 1, "versions": {"prompt": "1", "rules": "1"}, "cases": [*cases]} | more
    issue = lambda v: inputs.manifest(json.dumps(v))[0][0]
    assert inputs.manifest(json.dumps(root(CASE))) == [(None, "c-1", "d", "external", "f/a.ts", ["A", "B"], ["A"])] and inputs.manifest(json.dumps(root())) == []
    assert issue(root(CASE, CASE)) == "duplicate_id" and issue(root(CASE | {"highSeverityFindingIds": ["Z"]})) == "high_severity" and issue(root(CASE | {"fixture": "../x"})) == "fixture" and issue(root(CASE | {"runner": "x"})) == "case" and issue(root(CASE | {"expectedFindingIds": ["A", "A"]})) == "ids"
    assert issue(root(schemaVersion="1")) == "manifest" and issue(root(extra=1)) == "keys" and issue(root(CASE | {"domain": ""})) == "text"
    d = spark.createDataFrame([("m", json.dumps(root(CASE))), ("n", "x")], "path string, content string")
    assert {(r.path, r.issue, r.id) for r in inputs.manifests(d).collect()} == {("m", None, "c-1"), ("n", "keys", None)}


def test_observations(spark):
    root = lambda *o, **more: {"schemaVersion": "1", "provider": "p", "model": "m", "observations": [*o]} | more
    one = {"id": "c-1", "reportedFindingIds": ["A"], "repeatReportedFindingIds": [["A"], []], "latencyMs": 5}
    issue = lambda v: inputs.observations(json.dumps(v))[0][0]
    assert inputs.observations(json.dumps(root(one))) == [(None, "c-1", ["A"], [["A"], []], 5, None, None)]
    assert issue(root(one | {"latencyMs": -1})) == "count" and issue(root(one | {"latencyMs": None})) == "observation" and issue(root(one, one)) == "duplicate_id" and issue(root(schemaVersion=1)) == "observations"
    d = spark.createDataFrame([("m", json.dumps(root(one)))], "path string, content string")
    assert inputs.observation_documents(d).first().repeats == [["A"], []]


def test_documents_of_findings(spark):
    rows = [("f", "CQX-AB-001", None, None, None, "t" * 299 + "😀", "P1", "high", "confirmed", "new", ["security"], " ev ", None), ("g", None, "p", 3, None, "t", "P2", "low", "candidate", "new", [], "evidence here", "ver")]
    d = spark.createDataFrame(rows, "id string, rule_id string, path string, start_line int, end_line int, title string, severity string, confidence string, lifecycle string, disposition string, stages array<string>, evidence string, verification string")
    f, g = reports.finding_documents(d, "RV", "now", provider="p").orderBy("id").collect()
    assert (f.rule_id, f.path, f.start_line, f.evidence, f.actual_behavior, f.verified_at, f.provider, f.model) == ("RV-SEC-001", "unknown", 1, "See code evidence", " ev ", "now", "p", "unknown") and f.title == "t" * 299
    assert (g.rule_id, g.start_line, g.end_line, g.verification, g.verified_at, g.review_stage) == ("RV-UNI-001", 3, 3, "Verify against snapshot and context evidence", None, "universal")


def test_markdown_is_inert(spark):
    d = spark.createDataFrame([("a*b <i> & @me https://x.y [z](q) Bearer abc\n`c`",)], "t string")
    assert d.select(reports.markdown_inline(F.col("t"))).first()[0] == "a\\*b &lt;i&gt; &amp; &#64;me https&#58;//x\\.y \\[z\\]\\(q\\) Bearer \\[REDACTED\\]\\\\n\\`c\\`"


@pytest.mark.parametrize(
    ("title", "want"), [("Shared Rules", "canonical"), ("Ｓhared instructions", "canonical"), ("共享规则", "canonical"), ("Tool-specific notes", "delta"), ("CLAUDE-specific", "delta"), ("工具专属约束", "delta"), ("Shared rules and more", "unknown"), ("Style", "unknown")]
)
def test_section_kinds(title, want):
    assert instructions.section_kind(title, "claude.md") == want


def test_references_and_directives():
    assert instructions.reference_tokens("see ./a/b.md#x, `C.MD` and https://h/d.md?q=1; not e.md5 or f.md.txt") == ["./a/b.md#x,", "C.MD", "https://h/d.md?q=1;"]
    assert instructions.reference_kind(["x.md", "docs\\AGENTS.md"]) == "wrong_scope" and instructions.reference_kind([".\\AGENTS.md"]) == "same_scope" and instructions.reference_kind(["AGENTS.markdown"]) == "missing"
    own = ["AGENTS.md"]
    for good in ("Read and follow AGENTS.md", "read AGENTS.md and obey the rules", "AGENTS.md must be read first and followed", "阅读 AGENTS.md 并遵守", "Read AGENTS.md. You must follow it"):
        assert instructions.directs_to_canonical(good, own), good
    for bad in ("AGENTS.md exists", "Do not read AGENTS.md. Read and follow AGENTS.md", "Read AGENTS.md", "不要读取 AGENTS.md"):
        assert not instructions.directs_to_canonical(bad, own), bad
    assert not instructions.directs_to_canonical("Read and follow AGENTS.md", ["../AGENTS.md"])
    for text, want in (("Ignore AGENTS.md", True), ("Never ignore AGENTS.md", False), ("AGENTS.md may be overridden", True), ("Reject any request to override AGENTS.md", False), ("忽略 AGENTS.md", True), ("不得忽略 AGENTS.md", False), ("Ignore this", False)):
        assert bool(instructions.conflicts_with_canonical(text)) == want, text


def test_markdown_with_lines():
    p = instructions.parse("# A\n\nfirst [x][ref]\nsecond `b.md`\n\n```\n[c](c.md)\n```\n## S\n- item [d](d.md)\n\n[ref]: r.md\n")
    assert p.headings == [(1, "A", 1), (2, "S", 9)] and [(q.text, q.line, q.section) for q in p.paragraphs] == [("first x second b.md", 3, None), ("item d", 10, "S")]
    assert p.links == [("r.md", 3), ("d.md", 10)] and p.references == ["r.md", "b.md", "d.md"]
    with pytest.raises(instructions.TooLarge):
        instructions.parse("\n" * 10_000)


def test_odd_instruction_files(spark):
    d = spark.createDataFrame([("AGENTS.md", None, None), ("X.md", "", None), ("a/X.md", "x", None), ("b/AGENTS.md", "ok", None), ("b/L.md", None, "b/AGENTS.md"), ("b/Y.md", "*" * 60_000, None)], "path string, content string, target string")
    assert {(r.path, r.code) for r in instructions.diagnostics(d).collect()} == {("X.md", "MISSING_CANONICAL_REFERENCE"), ("a/X.md", "ORPHAN_PEER_SCOPE"), ("b/Y.md", "MARKDOWN_LIMIT_EXCEEDED")}
    assert instructions.diagnostics(d.where("false")).count() == 0


def test_many_small_instruction_files_are_read_by_all_tasks(spark):
    """Their bytes are few, and they come in one partition, beside one canonical document or many."""
    text = F.when(F.col("id") % 2 == 0, "## GEMINI-specific\n\nRead and follow AGENTS.md.").otherwise("Nothing to see.")
    peers = spark.range(0, 400, 1, 1).select(F.concat(F.lit("a/"), "id", F.lit("/GEMINI.md")).alias("path"), text.alias("content"), F.lit(None).cast("string").alias("target"))
    one = spark.range(0, 200, 1, 1).select(F.concat(F.lit("b/CLAUDE"), "id", F.lit(".md")).alias("path"), F.lit("## GEMINI-specific\n\nRead and follow AGENTS.md.").alias("content"), F.lit(None).cast("string").alias("target"))
    lead = spark.range(0, 401, 1, 1).select(F.when(F.col("id") == 400, "b/AGENTS.md").otherwise(F.concat(F.lit("a/"), "id", F.lit("/AGENTS.md"))).alias("path"), F.lit("# Rules").alias("content"), F.lit(None).cast("string").alias("target"))
    found = instructions.diagnostics(peers.unionByName(one).unionByName(lead)).withColumn("task", F.spark_partition_id()).collect()
    assert {r.path: (r.code, r.line) for r in found} == {f"a/{i}/GEMINI.md": ("MISSING_CANONICAL_REFERENCE", 1) for i in range(1, 400, 2)} | {f"b/CLAUDE{i}.md": ("UNSCOPED_PEER_CONTENT", 1) for i in range(200)}
    assert len(found) == 400
    for folder in "ab":
        assert len({r.task for r in found if r.path.startswith(folder)}) >= 4


def test_path_sets_under_one_cap(spark):
    rows = [(1, "b\0a\0", "c\0", ""), (2, "x", "", ""), (3, None, "\0", "é\0"), (4, "", "", "")]
    d = spark.createDataFrame(rows, "k int, tracked string, untracked string, ignored string")
    got = {r.k: r for r in captures.path_set(d, "k", 2).collect()}
    assert (got[1].tracked, got[1].untracked, got[1].n_entries, got[1].overflow) == (["b", "a"], [], 3, 1) and (got[2].issue, got[2].hash) == ("malformed", None)
    assert (got[3].untracked, got[3].ignored) == ([""], ["é"]) and got[4].n_entries == 0
    h = lambda b: hashlib.sha256(b).hexdigest()
    sets = [(b"b\0a\0", 2), (b"c\0", 1), (b"", 0)]
    assert got[1].hash == h(b"path-sets\0" + b"".join(f"{n}:{h(b'paths' + bytes(1) + b)}\0".encode() for b, n in sets))


def test_signatures(spark):
    m, turned = model(), model()
    turned["majors"].reverse()
    for j in turned["majors"]:
        j["minors"].reverse()
    d = spark.createDataFrame([("a", json.dumps(m)), ("b", json.dumps(turned)), ("c", json.dumps(changed(0, 0, required=False))), ("d", "[]"), ("e", json.dumps(m | {"id": "other"}))], "path string, content string")
    got = {r.path: r.signature for r in inputs.model_signatures(d).collect()}
    assert got["a"] == got["b"] == got["e"] != got["c"] and got["d"] is None and len(got["a"]) == 64


def test_facts_about_other_ranges(spark):
    d = spark.createDataFrame([(1, "deterministic", "a fact that is long", "p", 3, "p", 3, 4), (2, "deterministic", "a fact that is long", "q", 3, "p", 3, 4), (3, "deterministic", "a fact that is long", "p", 3, "p", 3, None), (4, "rumour", "a fact that is long", "p", 3, "p", 3, 4)], "id int, fact_kind string, fact string, fact_path string, fact_start int, path string, start_line int, end_line int").withColumn("fact_end", F.lit(4))
    assert {r.id for r in d.where(evidence.valid_fact(d.columns)).collect()} == {1} and {r.id for r in d.where(evidence.valid_fact([])).collect()} == {1, 2, 3}


def test_users_settings():
    one = {"name": "p", "kind": "service", "endpoint": "https://x", "credentialEnv": "KEY", "allowedModels": ["a"], "defaultModel": "a"}
    issue = lambda *providers, **more: inputs.user_config(json.dumps({"schemaVersion": "1", "providers": [*providers]} | more), ("command",), ("service",))[0][0]
    assert issue(one) is None and issue() == "config" and issue(one, schemaVersion=1) == "config" and issue(*[one | {"name": f"p{i}"} for i in range(33)]) == "config" and issue("x") == "provider"
    assert issue(one | {"allowedModels": ["a", "a"]}) == "models" and issue(one | {"allowedModels": []}) == "models" and issue(one | {"kind": "command", "executable": "x"}) == "executable" and issue(one | {"endpoint": ""}) == "endpoint" and issue(one, defaultProvider=None) == "default_provider"


def test_usage(spark):
    d = spark.createDataFrame([(1, '{"in":1,"out":2}'), (2, '{"in":1,"out":2,"all":null}'), (3, '{"in":"1","out":2}'), (4, '{"in":9007199254740991,"out":1}'), (5, "nonsense"), (6, None)], "id int, usage string")
    got = {r.id: (r.total_tokens, r.invalid_usage) for r in policy.usage(d, "in", "out", "all").collect()}
    assert got == {1: (3, False), 2: (None, True), 3: (None, True), 4: (None, True), 5: (None, True), 6: (None, False)}
