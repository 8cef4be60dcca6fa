"""Findings: merge of duplicates, order, gates, lifecycle transitions, severity caps and their place in the score."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfkc_fold, utf16, utf16_length

SEVERITIES = tuple("P0 P1 P2 P3 NIT".split())
#: The earlier lifecycle wins when duplicates merge.
LIFECYCLES = ("waived", "reported", "confirmed", "corroborated", "uncertain", "candidate", "dismissed")
CONFIDENCES = ("high", "medium", "low")
TRANSITIONS = {"candidate": "corroborated dismissed uncertain waived", "corroborated": "confirmed dismissed uncertain waived", "confirmed": "reported waived", "uncertain": "corroborated dismissed waived", "waived": "reported"}
CAPS = {"P0": 0, "P1": 2, "P2": 5, "P3": 7, "NIT": 9}
CONFLICT = "Duplicates disagree on severity; someone has to decide"


def rank(column: str | Column, names: tuple[str, ...]) -> Column:
    """Position of a name, from 0."""
    return F.array_position(F.array(*map(F.lit, names)), column if isinstance(column, Column) else F.col(column)) - 1


def name(position: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), position.cast("int"))


def preferred(text: str, among: Column | None = None) -> Column:
    """The text of a group with most UTF-16 units; of equally long ones the smallest in their order. Nulls don't count."""
    key = F.struct((-utf16_length(F.col(text))).alias("shorter"), utf16(F.col(text)).alias("units"), F.col(text).alias("text"))
    keep = F.col(text).isNotNull() if among is None else F.col(text).isNotNull() & among
    return F.min(F.when(keep, key))["text"]


#: A finding's fields in its canonical form, by the column that holds each.
CANONICAL = {
    "actualBehavior": "actual_behavior", "blockingVerificationUnresolved": "unresolved", "confidence": "confidence", "disposition": "disposition", "evidence": "evidence", "expectedBehavior": "expected_behavior", "id": "id", "impact": "impact", "lifecycle": "lifecycle",
    "location": None, "remediation": "remediation", "ruleId": "rule_id", "severity": "severity", "stages": "stages", "title": "title", "trigger": "trigger", "verification": "verification",
}


def canonical(findings: DataFrame) -> Column:
    """Canonical JSON of a finding: keys in order, explicit nulls, null for a missing place."""
    of = lambda c, kind="string": F.col(c) if c in findings.columns else F.lit(None).cast(kind)
    place = F.when(F.col("path").isNotNull(), F.struct(F.col("end_line").alias("endLine"), "path", F.col("start_line").alias("startLine")))
    fields = [(place if column is None else F.array_sort("stages") if column == "stages" else F.coalesce("unresolved", F.lit(False)) if column == "unresolved" else of(column)).alias(name) for name, column in CANONICAL.items()]
    whole = F.struct(of("created_at").cast("string").alias("createdAt"), F.struct(*fields).alias("finding"), of("model").alias("model"), of("provider").alias("provider"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def merged(findings: DataFrame) -> DataFrame:
    """One row for each group of duplicates: same rule, place and title without case.

    A single finding stays as it is. Of several, severity and confidence are the strongest, the lifecycle the most
    decided; other fields come from the row with the smallest canonical JSON. If severities differ the result is
    uncertain, with low confidence.
    """
    keyed = findings.withColumns({"key_title": nfkc_fold("title"), "stages": F.array("stage")})
    keyed = keyed.withColumn("tie", utf16(canonical(keyed)))
    keys = ["rule_id", "path", "start_line", "end_line", "key_title"]
    # Ranks first, so that the group's lifecycle is known when its authorities are looked for.
    group = Window.partitionBy(*keys)
    best = F.when(F.min(rank("severity", SEVERITIES)).over(group) != F.max(rank("severity", SEVERITIES)).over(group), F.lit(LIFECYCLES.index("uncertain"))).otherwise(F.min(rank("lifecycle", LIFECYCLES)).over(group))
    rows = keyed.withColumn("decided", best)
    rows = rows.withColumn("authority", (rank("lifecycle", LIFECYCLES) == F.col("decided")) | ~F.max(rank("lifecycle", LIFECYCLES) == F.col("decided")).over(group))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by(F.struct(*(c for c in findings.columns if c not in keys)), "tie").alias("kept"), F.min(rank("severity", SEVERITIES)).alias("severity"), (F.min("severity") != F.max("severity")).alias("conflict"), F.first("decided").alias("lifecycle"),
        F.min(F.when(F.col("authority"), rank("confidence", CONFIDENCES))).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("stages")))).alias("stages"), preferred("evidence").alias("evidence"), preferred("verification", F.col("authority")).alias("verification"), F.bool_or("unresolved").alias("unresolved"),
    )
    many, lifecycle = F.col("n") > 1, name(F.col("lifecycle"), LIFECYCLES)
    return out.select(
        F.col("kept.id").alias("id"), "rule_id", "path", "start_line", "end_line", F.col("kept.title").alias("title"), name(F.col("severity"), SEVERITIES).alias("severity"), F.when(many, lifecycle).otherwise(F.col("kept.lifecycle")).alias("lifecycle"),
        F.when(~many, F.col("kept.confidence")).when(lifecycle == "uncertain", "low").otherwise(name(F.col("confidence"), CONFIDENCES)).alias("confidence"), F.col("kept.disposition").alias("disposition"), "stages",
        F.when(many, F.col("evidence")).otherwise(F.col("kept.evidence")).alias("evidence"), F.when(many & F.col("conflict"), CONFLICT).when(many, F.col("verification")).otherwise(F.col("kept.verification")).alias("verification"),
        F.when(many, (lifecycle == "corroborated") & F.col("unresolved")).otherwise(F.col("kept.unresolved")).alias("unresolved"), "n",
    )


def ordered(findings: DataFrame, within: str) -> DataFrame:
    """Findings numbered by severity, then id."""
    return findings.withColumn("ordinal", F.row_number().over(Window.partitionBy(within).orderBy(rank("severity", SEVERITIES), "id")))


def conflicts(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under which candidates disagree on severity."""
    return candidates.groupBy(*keys).agg(F.count_distinct("severity").alias("severities")).where("severities > 1").drop("severities")


def gate(findings: DataFrame, by: str, mode: str | None = None, block_at: str = "P1", minimum: str = "high") -> DataFrame:
    """(by, gate). Only confirmed and reported findings count, and with a mode only those of enough confidence."""
    counts = F.col("lifecycle").isin("confirmed", "reported")
    at = rank("severity", SEVERITIES)
    if mode is None:
        block, warn = counts & (at <= 1), counts & (at == 2)
    else:
        sure = counts & (rank("confidence", CONFIDENCES) <= CONFIDENCES.index("high" if minimum == "deterministic" else minimum))
        block, warn = sure & (at <= SEVERITIES.index(block_at)) & F.lit(mode == "block"), sure & (at <= 2)
    return findings.groupBy(by).agg(F.when(F.bool_or("incomplete"), "INCOMPLETE").when(F.bool_or(block), "BLOCK").when(F.bool_or(warn), "WARN").otherwise("PASS").alias("gate"))


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Changes (…, lifecycle, next) that no finding may make."""
    legal = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v.split()))) for k, v in TRANSITIONS.items()))
    return changes.where(~F.coalesce(F.array_contains(F.try_element_at(legal, "lifecycle"), F.col("next")), F.lit(False)))


def buckets(findings: DataFrame, by: str) -> DataFrame:
    """Counts of findings by what became of them."""
    kind = F.when(F.col("lifecycle").isin("confirmed", "reported"), "confirmed").when(F.col("lifecycle") == "waived", "waived").when(F.col("lifecycle") == "dismissed", "dismissed").otherwise("uncertain")
    return findings.groupBy(by).agg(*(F.count_if(kind == k).alias(f"n_{k}") for k in ("confirmed", "uncertain", "dismissed", "waived")))


def minor_of() -> Column:
    """The minor that a finding speaks about, from its stages (a list in one text) and its title and evidence."""
    text, stages = F.lower(F.concat_ws(" ", "title", "evidence")), F.col("stage")
    on = lambda *names: F.lit(False) if not names else on(*names[1:]) | stages.contains(names[0])

    def first(default: str, *rules: tuple[str, str]) -> Column:
        out = None
        for pattern, minor in rules:
            out = F.when(text.rlike(pattern), minor) if out is None else out.when(text.rlike(pattern), minor)
        return out.otherwise(default) if rules else F.lit(default)

    return (
        F.when(on("security", "permissions"), first("authentication-authorization-tenant-isolation", ("api[_-]?key|password|token|secret|credential", "secrets-privacy-logging-retention-deletion"), ("injection|ssrf|(path|file) traversal|open redirect", "input-injection-path-url-file-safety")))
        .when(on("concurrency"), first("race-atomicity-toctou", ("lock|contention|mutex", "lock-scope-ownership-contention"), ("queue|retry|backpressure|unbounded", "bounded-work-retries-queues-backpressure"), ("stampede|multi-instance|cache", "multi-instance-stampede-resource-bounds"), ("single-flight|dedup|idempoten", "single-flight-idempotency-deduplication"), ("fan.?out|capacity|amplif|hot.?path", "hot-path-amplification-capacity")))
        .when(on("testing"), first("observable-behavior-coverage", ("fail|error|boundary", "failure-boundary-coverage")))
        .when(on("readability"), first("function-responsibility-size", ("try|catch|error boundary", "try-catch-error-boundaries"), ("ternary|fallback|nested", "conditional-fallback-clarity"), ("control flow|stage|state machine", "control-flow-visible-stages")))
        .when(on("compatibility", "data"), "api-event-schema-compatibility")
        .when(on("behavior", "universal"), first("primary-path", ("timeout|retry|cancel", "failure-timeout-retry-cancellation"), ("idempoten|side effect|state", "state-side-effects-idempotency"), ("invalid|boundary|input", "boundaries-invalid-input")))
        .otherwise("intent-contract")
    )


def capped(assessments: DataFrame, findings: DataFrame) -> DataFrame:
    """Assessments under the findings (entity, minor_id, severity, confidence) that speak about them.

    A scored one keeps its confidence and gets at most the lowest cap; one that wasn't applicable becomes scored at
    the cap with the weakest confidence of its findings; one that wasn't assessed stays so.
    """
    cap = F.min(F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CAPS.items())), F.col("severity")))
    caps = findings.groupBy("entity", "minor_id").agg(cap.alias("cap"), F.max(rank("confidence", CONFIDENCES)).alias("weakest"), F.array_sort(F.collect_set("id")).alias("ids"))
    touched, revived = F.col("cap").isNotNull() & (F.col("status") != "not_assessed"), F.col("cap").isNotNull() & (F.col("status") == "not_applicable")
    return assessments.join(caps, ["entity", "minor_id"], "left").select(
        "entity", "minor_id", F.when(revived, "scored").otherwise(F.col("status")).alias("status"), F.when(revived, F.col("cap")).when(touched, F.least("half_points", "cap")).otherwise(F.col("half_points")).alias("half_points"),
        F.when(revived, name(F.col("weakest"), CONFIDENCES)).otherwise(F.col("confidence")).alias("confidence"), F.when(touched, bounded("ids", 128)).alias("evidence"),
    )


def bounded(column: str, limit: int) -> Column:
    """A list with at most ``limit`` entries; the last tells how many were left out."""
    c = F.col(column)
    return F.when(F.size(c) <= limit, c).otherwise(F.concat(F.slice(c, 1, limit - 1), F.array(F.concat(F.lit("omitted "), (F.size(c) - (limit - 1)).cast("string")))))
