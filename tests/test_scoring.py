from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import scoring
from siftwell.plans import relations as R

COLUMNS = "entity bigint, minor_id string, status string, half_points int, confidence string"


def assessed(spark, change=lambda minor, major: {}):
    rows = []
    for _, minor, _, _, major, _ in R.MINOR_ROWS:
        r = {"entity": 1, "minor_id": minor, "status": "scored", "half_points": 10, "confidence": "high"} | change(minor, major)
        if r["status"] != "scored":
            r |= {"half_points": None, "confidence": None}
        rows.append(tuple(r.values()))
    return spark.createDataFrame(rows, COLUMNS)


def total(spark, assessments):
    return scoring.score(assessments, scoring.minor_model(spark)).collect()[0]


def test_model_is_whole(spark):
    assert scoring.model_issues(scoring.minor_model(spark)).count() == 0
    assert sum(w for _, w, _ in R.MODEL) == 1000 and len(R.MINOR_ROWS) == 37


def test_full_marks(spark):
    t = total(spark, assessed(spark))
    assert (t.earned_tenths, t.normalized, t.coverage_tenths, t.gate, t.confidence) == (1000, "100.0", 1000, "PASS", "high")


def test_major_that_does_not_apply(spark):
    t = total(spark, assessed(spark, lambda _, major: {"status": "not_applicable"} if major == "security" else {}))
    assert (t.earned_tenths, t.assessed, t.applicable, t.normalized, t.gate) == (880, 880, 880, "100.0", "PASS")


def test_partial_total(spark):
    """73.0 of 86.0 points are 84.9 percent; the gap leaves the gate open."""
    majors = {"correctness": 8, "readability": 8, "architecture": 10, "testing": 10}
    points = {"primary-path": 5, "intent-contract": 5}
    gaps = {"security", "documentation-repository-hygiene-operability"}
    t = total(spark, assessed(spark, lambda minor, major: {"status": "not_assessed"} if {minor, major} & gaps else {"half_points": points.get(minor, majors.get(major, 10))}))
    assert t.assessed == 860 and t.coverage_tenths == 860 and t.gate == "INCOMPLETE"
    assert scoring.half_up_tenths(F.lit(73_0 * 50 * 2), F.lit(860)) is not None
    assert spark.range(1).select(scoring.half_up_tenths(F.lit(36500 * 2), F.lit(860)).alias("x")).first().x == 849


def test_sum_before_rounding(spark):
    """Two minors that show 0.1 each sum to 0.1."""
    shown = spark.createDataFrame([(25,), (25,)], "units bigint").select("units", scoring.half_up_tenths(F.col("units"), F.lit(500)).alias("t"))
    assert [r.t for r in shown.collect()] == [1, 1]
    assert shown.agg(scoring.half_up_tenths(F.sum("units"), F.lit(500)).alias("t")).first().t == 1


def test_nothing_assessed(spark):
    t = total(spark, assessed(spark, lambda *_: {"status": "not_assessed"}))
    assert (t.normalized_tenths, t.normalized, t.confidence, t.coverage_tenths) == (None, "N/A", None, 0)


def test_order_and_partitions_do_not_matter(spark):
    a = assessed(spark, lambda minor, _: {"half_points": len(minor) % 11})
    assert total(spark, a) == total(spark, a.orderBy(F.desc("minor_id")).repartition(7))


def test_baseline(spark):
    model = scoring.minor_model(spark)
    new = scoring.minor_scores(assessed(spark, lambda minor, _: {"half_points": 8} if minor == "primary-path" else {"status": "not_assessed"} if minor == "intent-contract" else {}), model)
    old = scoring.minor_scores(assessed(spark), model)
    changes = {r.minor_id: (r.reason, r.shown) for r in scoring.minor_changes(new, old).collect()}
    assert changes["primary-path"] == ("numeric_delta", "-0.8")
    assert changes["intent-contract"] == ("assessment_status_changed", "state changed")
    majors = {r.major_id: (r.comparable, r.shown) for r in scoring.major_changes(new, old).collect()}
    assert majors["correctness"] == (False, "state changed") and majors["testing"] == (True, "0.0")


def test_gate_precedence(spark):
    totals = spark.createDataFrame([(1, "INCOMPLETE"), (2, "INCOMPLETE"), (3, "PASS"), (4, "PASS")], "entity int, gate string")
    context = spark.createDataFrame([(1, "PASS", True), (2, "WARN", False), (3, "WARN", False)], "entity int, context_gate string, blocking boolean")
    assert {r.entity: r.gate for r in scoring.score_gate(totals, context).collect()} == {1: "BLOCK", 2: "INCOMPLETE", 3: "WARN", 4: "PASS"}


def test_text_budget(spark):
    rows = spark.createDataFrame([(1, 1, "ab"), (1, 2, "é"), (1, 3, "x"), (2, 1, "x")], "entity int, n int, t string")
    assert {r.entity: (r.fits, r.breach) for r in scoring.text_budget(rows, 4, "n", "t").collect()} == {1: (False, 3), 2: (True, None)}


def test_incompatible_baselines(spark):
    h = spark.createDataFrame([("a", None, "m", "1", "s", "a", None, "m", "1", "s"), ("a", None, "m", "1", "s", "b", None, "m", "1", "s"), ("a", "x", "m", "1", "s", "a", "x", "m", "2", "s"), ("a", "x", "m", "1", "s", "a", "x", "m", "1", "t")], "scope string, domain string, model string, version string, signature string, old_scope string, old_domain string, old_model string, old_version string, old_signature string")
    assert [r.incompatible for r in scoring.baseline_incompatibility(h).collect()] == [None, "scope", "model", "definition"]
