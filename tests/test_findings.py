from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftwell.operators import findings

COLUMNS = "id string, rule_id string, path string, start_line int, end_line int, title string, severity string, lifecycle string, confidence string, disposition string, stage string, evidence string, verification string, unresolved boolean"


def make(spark, *changes):
    base = dict(id="a", rule_id="r", path="p", start_line=1, end_line=2, title="Title", severity="P2", lifecycle="confirmed", confidence="high", disposition="new", stage="testing", evidence="some evidence", verification="checked", unresolved=False)
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], COLUMNS)


def test_single_finding_is_kept_as_it_is(spark):
    r = findings.merged(make(spark, {"lifecycle": "uncertain", "confidence": "high"})).first()
    assert (r.lifecycle, r.confidence, r.n) == ("uncertain", "high", 1)


def test_duplicates_merge(spark):
    r = findings.merged(make(spark, {"id": "b", "title": " TITLE", "confidence": "low", "stage": "security", "evidence": "a longer evidence"}, {"id": "a", "lifecycle": "candidate"})).collect()
    assert len(r) == 1
    assert (r[0].lifecycle, r[0].confidence, r[0].stages, r[0].evidence, r[0].severity) == ("confirmed", "low", ["security", "testing"], "a longer evidence", "P2")


def test_compatibility_forms_are_one_title(spark):
    assert findings.merged(make(spark, {"title": "ﬁx"}, {"title": "FIX", "id": "b"})).count() == 1


def test_severity_conflict_is_uncertain(spark):
    r = findings.merged(make(spark, {}, {"id": "b", "severity": "P0"})).first()
    assert (r.severity, r.lifecycle, r.confidence, r.verification) == ("P0", "uncertain", "low", findings.CONFLICT)


def test_unresolved_survives_only_corroboration(spark):
    same = findings.merged(make(spark, {"lifecycle": "corroborated", "unresolved": True}, {"id": "b", "lifecycle": "corroborated"})).first()
    other = findings.merged(make(spark, {"lifecycle": "corroborated", "unresolved": True}, {"id": "b"})).first()
    assert same.unresolved and not other.unresolved


def test_equally_long_texts_take_the_smaller(spark):
    assert findings.merged(make(spark, {"evidence": "bbb"}, {"id": "b", "evidence": "abc"})).first().evidence == "abc"


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.randoms(use_true_random=False))
def test_merge_does_not_depend_on_order(spark, r: random.Random):
    rows = [{"id": f"f{i}", "severity": r.choice(["P1", "P2"]), "lifecycle": r.choice(findings.LIFECYCLES), "confidence": r.choice(findings.CONFIDENCES), "start_line": r.randint(1, 2), "evidence": "e" * r.randint(1, 3)} for i in range(8)]
    once = sorted(findings.merged(make(spark, *rows)).collect())
    r.shuffle(rows)
    assert sorted(findings.merged(make(spark, *rows).repartition(3)).collect()) == once


def test_gates(spark):
    def gate(*changes, incomplete=False, **options):
        from pyspark.sql import functions as F

        return findings.gate(make(spark, *changes).withColumns({"g": F.lit(1), "incomplete": F.lit(incomplete)}), "g", **options).first().gate

    assert gate({"severity": "P1"}) == "BLOCK"
    assert gate({"severity": "P1"}, incomplete=True) == "INCOMPLETE"
    assert gate({"severity": "P2"}) == "WARN"
    assert gate({"severity": "P0", "lifecycle": "uncertain"}) == "PASS"
    assert gate({"severity": "P1"}, mode="warn") == "WARN"
    assert gate({"severity": "P1", "confidence": "low"}, mode="block") == "PASS"
    assert gate({"severity": "P2"}, mode="block", block_at="P2", minimum="deterministic") == "BLOCK"


def test_transitions(spark):
    rows = spark.createDataFrame([("candidate", "confirmed"), ("candidate", "waived"), ("dismissed", "reported"), ("waived", "reported"), ("confirmed", "reported")], "lifecycle string, next string")
    assert {tuple(r) for r in findings.illegal_transitions(rows).collect()} == {("candidate", "confirmed"), ("dismissed", "reported")}


def test_caps(spark):
    a = spark.createDataFrame([(1, "x", "scored", 9, "high"), (1, "y", "not_applicable", None, None), (1, "z", "not_assessed", None, None), (1, "w", "scored", 3, "low")], "entity int, minor_id string, status string, half_points int, confidence string")
    f = spark.createDataFrame([(1, m, s, c, f"{m}{s}") for m, s, c in (("x", "P2", "low"), ("x", "NIT", "high"), ("y", "P1", "medium"), ("z", "P0", "high"))], "entity int, minor_id string, severity string, confidence string, id string")
    got = {r.minor_id: (r.status, r.half_points, r.confidence) for r in findings.capped(a, f).collect()}
    assert got == {"x": ("scored", 5, "high"), "y": ("scored", 2, "medium"), "z": ("not_assessed", None, None), "w": ("scored", 3, "low")}


def test_bounded_list(spark):
    from pyspark.sql import functions as F

    d = spark.range(1).select(F.array(*(F.lit(str(i)) for i in range(5))).alias("x"))
    assert d.select(findings.bounded("x", 3).alias("y")).first().y == ["0", "1", "omitted 3"]
    assert d.select(findings.bounded("x", 5).alias("y")).first().y == list("01234")
