"""The registered queries of the library and, for each that SQL can express, DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, documents, evaluation, evidence, findings, ledger, policy, readability, scoring, selection
from . import relations as R
from .registry import QUERIES, SQL, query  # noqa: F401
from .relations import relation

# Scoring. The SQL adds up the same integers in one statement each.

SCORED = "(SELECT a.*, m.major_id, m.weight, m.major_weight, CAST(CASE WHEN a.status = 'scored' THEN m.weight * a.half_points * 5 ELSE 0 END AS BIGINT) AS units, CAST(CASE WHEN a.status = 'scored' THEN m.weight ELSE 0 END AS BIGINT) AS assessed, CAST(CASE WHEN a.status <> 'not_applicable' THEN m.weight ELSE 0 END AS BIGINT) AS applicable FROM ({relation}) a JOIN " + R.MINORS + " m ON a.minor_id = m.minor_id)"
RANK = "CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END"
NAME = "CASE min({r}) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END"


def half_up(above: str, below: str) -> str:
    return f"CASE WHEN {below} > 0 THEN CAST(floor(({above}) * 10 / ({below}) + 0.5) AS BIGINT) END"


def shown(tenths: str) -> str:
    return f"CASE WHEN {tenths} IS NULL THEN 'N/A' ELSE CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) END"


def signed(above: str, below: str) -> str:
    t = f"({half_up(f'abs({above})', below)})"
    return f"CASE WHEN {t} IS NULL THEN 'N/A' WHEN {t} = 0 THEN '0.0' ELSE CASE WHEN {above} > 0 THEN '+' ELSE '-' END || ({shown(t)}) END"


def scored(text: str) -> str:
    return SCORED.replace("{relation}", text)


TOTALS = f"{half_up('sum(units)', '500')} AS earned_tenths, {half_up('sum(units) * 2', 'sum(assessed)')} AS normalized_tenths, {half_up('sum(assessed) * 100', 'sum(applicable)')} AS coverage_tenths, CAST(sum(units) AS BIGINT) AS units, CAST(sum(assessed) AS BIGINT) AS assessed, CAST(sum(applicable) AS BIGINT) AS applicable"


def minors(spark: SparkSession, sf_dir: str, text: str = R.ASSESSMENTS) -> DataFrame:
    return scoring.minor_scores(relation(spark, sf_dir, text), scoring.minor_model(spark))


def total_sql(text: str) -> str:
    return f"SELECT entity, {TOTALS}, {shown('(' + half_up('sum(units) * 2', 'sum(assessed)') + ')')} AS normalized, {NAME.replace('{r}', RANK)} AS confidence, CASE WHEN bool_or(status = 'not_assessed') THEN 'INCOMPLETE' ELSE 'PASS' END AS gate FROM {scored(text)} GROUP BY entity"


@query(total_sql(R.ASSESSMENTS))
def score_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.total_scores(scoring.major_scores(minors(spark, sf_dir)))


@query(f"SELECT entity, major_id, {TOTALS}, {shown('(' + half_up('sum(units) * 2', 'sum(assessed)') + ')')} AS normalized, {NAME.replace('{r}', RANK)} AS confidence, CASE WHEN min(status) = max(status) THEN min(status) ELSE 'mixed' END AS status FROM {scored(R.ASSESSMENTS)} GROUP BY entity, major_id")
def score_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.major_scores(minors(spark, sf_dir)).drop("rank", "gap")


@query(f"SELECT entity, minor_id, major_id, units, assessed, applicable FROM {scored(R.ASSESSMENTS)}")
def score_minors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minors(spark, sf_dir).select("entity", "minor_id", "major_id", *scoring.SUMS)


@query(f"SELECT entity, {TOTALS} FROM {scored(R.ASSESSMENTS)} WHERE major_id = 'security' GROUP BY entity")
def score_focused_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.total_scores(scoring.major_scores(scoring.focused(minors(spark, sf_dir), "security"))).drop("normalized", "confidence", "gate")


OVERRIDES = R.values([("primary-path", 60), ("intent-contract", 20), ("testing", 120), ("unknown", 5)], "id, weight")


@query(f"SELECT m.minor_id, CAST(coalesce(o.weight, m.weight) AS INT) AS weight, m.major_id, CAST(coalesce(p.weight, m.major_weight) AS INT) AS major_weight FROM {R.MINORS} m LEFT JOIN {OVERRIDES} o ON o.id = m.minor_id LEFT JOIN {OVERRIDES} p ON p.id = m.major_id")
def score_profile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.overridden(scoring.minor_model(spark), spark.sql(f"SELECT * FROM {OVERRIDES}")).select("minor_id", "weight", "major_id", "major_weight")


BROKEN_MODEL = R.values([*[r for r in R.MINOR_ROWS if r[4] != "testing"], (99, "primary-path", 40, 0, "correctness", 200), (98, " ", 0, 9, "style", 10)], "minor_no, minor_id, weight, major_no, major_id, major_weight")


@query(f"""WITH m AS (SELECT * FROM {BROKEN_MODEL}), j AS (SELECT major_id, max(major_weight) AS w, sum(weight) AS s FROM m GROUP BY major_id)
SELECT 'MINOR_TOTAL_MISMATCH' AS code, major_id AS subject FROM j WHERE s <> w UNION ALL SELECT 'INVALID_MAJOR_WEIGHT', major_id FROM j WHERE w <= 0 UNION ALL SELECT 'INVALID_MINOR_WEIGHT', minor_id FROM m WHERE weight <= 0
UNION ALL SELECT 'UNNAMED_MINOR', major_id FROM m WHERE trim(minor_id) = '' UNION ALL SELECT 'DUPLICATE_MINOR_ID', minor_id FROM m GROUP BY minor_id HAVING count(*) > 1
UNION ALL SELECT 'MAJOR_TOTAL_INVALID', 'majors' FROM j HAVING sum(w) <> 1000 UNION ALL SELECT 'MAJOR_SET_INVALID', 'majors' WHERE EXISTS (SELECT major_id FROM j EXCEPT SELECT major_id FROM {R.MINORS} q) OR EXISTS (SELECT major_id FROM {R.MINORS} q EXCEPT SELECT major_id FROM j)""")
def score_model_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.model_issues(spark.sql(f"SELECT * FROM {BROKEN_MODEL}"))


CHANGED = f"(SELECT n.entity, n.minor_id, n.major_id, n.status, n.units, n.assessed, o.status AS old_status, o.units AS old_units, o.assessed AS old_assessed FROM {scored(R.SUPPLIER_ASSESSMENTS)} n JOIN {scored(R.BASELINE_ASSESSMENTS)} o ON n.entity = o.entity AND n.minor_id = o.minor_id)"
DELTA = ("sum(units) * 2 * sum(old_assessed) - sum(old_units) * 2 * sum(assessed)", "sum(assessed) * sum(old_assessed)")


@query(f"""SELECT entity, minor_id, major_id, CASE WHEN status <> old_status THEN 'assessment_status_changed' WHEN status = 'scored' THEN 'numeric_delta' ELSE status || '_unchanged_non_numeric' END AS reason, CASE WHEN status = old_status AND status = 'scored' THEN units - old_units END AS delta_units,
CASE WHEN status <> old_status THEN 'state changed' WHEN status = 'scored' THEN {signed('(units - old_units)', '500')} ELSE replace(status, '_', ' ') || ' unchanged' END AS shown FROM {CHANGED}""")
def baseline_minor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.minor_changes(minors(spark, sf_dir, R.SUPPLIER_ASSESSMENTS), minors(spark, sf_dir, R.BASELINE_ASSESSMENTS))


@query(f"SELECT entity, major_id, bool_and(status = old_status) AND {DELTA[1]} > 0 AS comparable, CASE WHEN NOT bool_and(status = old_status) THEN 'state changed' ELSE {signed('(' + DELTA[0] + ')', '(' + DELTA[1] + ')')} END AS shown FROM {CHANGED} GROUP BY entity, major_id")
def baseline_major_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.major_changes(minors(spark, sf_dir, R.SUPPLIER_ASSESSMENTS), minors(spark, sf_dir, R.BASELINE_ASSESSMENTS))


FAULTY = f"SELECT entity, CASE WHEN minor_id = 'primary-path' AND entity % 3 = 0 THEN 'other' ELSE minor_id END AS minor_id FROM ({R.SUPPLIER_ASSESSMENTS}) UNION ALL SELECT o_custkey, 'primary-path' FROM {{orders}} WHERE o_orderkey < 40"


@query(f"""WITH f AS ({FAULTY.replace(f'({R.SUPPLIER_ASSESSMENTS})', f'({R.SUPPLIER_ASSESSMENTS}) s')}), n AS (SELECT entity, minor_id, count(*) AS n FROM f GROUP BY entity, minor_id), g AS (SELECT entity, minor_id FROM (SELECT DISTINCT entity FROM f) e CROSS JOIN {R.MINORS} m)
SELECT coalesce(g.entity, n.entity) AS entity, coalesce(g.minor_id, n.minor_id) AS minor_id, CASE WHEN g.minor_id IS NULL THEN 'unknown' WHEN n.n IS NULL THEN 'missing' ELSE 'duplicate' END AS issue FROM g FULL JOIN n ON g.entity = n.entity AND g.minor_id = n.minor_id WHERE g.minor_id IS NULL OR n.n IS NULL OR n.n > 1""")
def assessment_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cover_issues(relation(spark, sf_dir, FAULTY), scoring.minor_model(spark))


CONTEXT_GATE = "CASE WHEN s_suppkey % 5 = 0 THEN 'BLOCK' WHEN s_suppkey % 5 = 1 THEN 'WARN' WHEN s_suppkey % 5 = 2 THEN 'INCOMPLETE' ELSE 'PASS' END"
CONTEXTS = f"SELECT s_suppkey AS entity, {CONTEXT_GATE} AS context_gate, s_suppkey % 7 = 0 AS blocking FROM {{supplier}}"


@query(f"""SELECT t.entity, CASE WHEN c.context_gate = 'BLOCK' OR c.blocking THEN 'BLOCK' WHEN c.context_gate = 'INCOMPLETE' OR t.gap THEN 'INCOMPLETE' ELSE c.context_gate END AS gate
FROM (SELECT entity, bool_or(status = 'not_assessed') AS gap FROM ({R.BASELINE_ASSESSMENTS}) b GROUP BY entity) t LEFT JOIN ({CONTEXTS}) c ON t.entity = c.entity""")
def score_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = scoring.total_scores(scoring.major_scores(minors(spark, sf_dir, R.BASELINE_ASSESSMENTS)))
    return scoring.score_gate(totals, relation(spark, sf_dir, CONTEXTS))


# Findings.

SEV = "CASE severity WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 ELSE 4 END"
LIFE = "CASE lifecycle WHEN 'waived' THEN 0 WHEN 'reported' THEN 1 WHEN 'confirmed' THEN 2 WHEN 'corroborated' THEN 3 WHEN 'uncertain' THEN 4 WHEN 'candidate' THEN 5 ELSE 6 END"
CONF = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


def named(rank: str, names: tuple[str, ...]) -> str:
    return f"CASE {rank} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


PLACE = "CASE WHEN path IS NOT NULL THEN {{'endLine': end_line, 'path': path, 'startLine': start_line}} END"
TIE_FIELDS = {"blockingVerificationUnresolved": "unresolved", "confidence": "confidence", "disposition": "disposition", "evidence": "evidence", "id": "id", "lifecycle": "lifecycle", "location": PLACE, "ruleId": "rule_id", "severity": "severity", "stages": "[stage]", "title": "title", "verification": "verification"}
TIE = "to_json({{" + ", ".join(f"'{name}': {column}" for name, column in TIE_FIELDS.items()) + "}})"
#: UTF-16 units: the one sign beyond the basic plane counts twice.
UNITS = "(length({c}) + length(regexp_replace({c}, '[^😀]', '', 'g')))"


@query(f"""WITH f AS (SELECT *, lower(trim(replace(title, 'ﬁ', 'fi'))) AS kt, {SEV} AS sr, {LIFE} AS lr, {CONF} AS cr, {TIE} AS tie FROM ({{findings}}) x),
g AS (SELECT *, CASE WHEN min(sr) OVER k <> max(sr) OVER k THEN 4 ELSE min(lr) OVER k END AS decided FROM f WINDOW k AS (PARTITION BY rule_id, path, start_line, end_line, kt)),
h AS (SELECT *, lr = decided OR NOT bool_or(lr = decided) OVER (PARTITION BY rule_id, path, start_line, end_line, kt) AS auth FROM g),
m AS (SELECT rule_id, path, start_line, end_line, count(*) AS n, arg_min(id, tie) AS id, arg_min(title, tie) AS title, arg_min(disposition, tie) AS disposition, arg_min(lifecycle, tie) AS l1, arg_min(confidence, tie) AS c1, bool_and(unresolved) AS u1, min(sr) AS sr, min(sr) <> max(sr) AS conflict, min(decided) AS lr, min(cr) FILTER (auth) AS cr,
 list_sort(list_distinct(list(stage))) AS stages, arg_min(evidence, {{{{'a': -{UNITS.replace('{c}', 'evidence')}, 'b': evidence}}}}) AS evidence, arg_min(verification, {{{{'a': -length(verification), 'b': verification}}}}) FILTER (auth AND verification IS NOT NULL) AS ver, arg_min(coalesce(verification, '<none>'), tie) AS v1, bool_or(unresolved) AS u FROM h GROUP BY rule_id, path, start_line, end_line, kt)
SELECT id, rule_id, path, start_line, end_line, title, {named('sr', findings.SEVERITIES)} AS severity, CASE WHEN n > 1 THEN {named('lr', findings.LIFECYCLES)} ELSE l1 END AS lifecycle, CASE WHEN n = 1 THEN c1 WHEN lr = 4 THEN 'low' ELSE {named('cr', findings.CONFIDENCES)} END AS confidence, disposition, stages, evidence,
 CASE WHEN n = 1 THEN nullif(v1, '<none>') WHEN conflict THEN '{findings.CONFLICT}' ELSE ver END AS verification, CASE WHEN n = 1 THEN u1 ELSE lr = 3 AND u END AS unresolved, n FROM m""".replace("{{", "{").replace("}}", "}").replace("{findings}", R.FINDINGS))
def findings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.merged(relation(spark, sf_dir, R.FINDINGS))


@query(f"SELECT user_id, id, severity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {SEV}, id) AS INT) AS ordinal FROM ({R.FINDINGS}) f")
def findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.ordered(relation(spark, sf_dir, R.FINDINGS), "user_id").select("user_id", "id", "severity", "ordinal")


def gate_sql(block: str, warn: str) -> str:
    return f"SELECT user_id, CASE WHEN bool_or(user_id % 10 = 3) THEN 'INCOMPLETE' WHEN bool_or({block}) THEN 'BLOCK' WHEN bool_or({warn}) THEN 'WARN' ELSE 'PASS' END AS gate FROM ({R.FINDINGS}) f GROUP BY user_id"


def gated(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return findings.gate(relation(spark, sf_dir, R.FINDINGS).withColumn("incomplete", F.col("user_id") % 10 == 3), "user_id", **options)


@query(gate_sql("lifecycle IN ('confirmed', 'reported') AND severity IN ('P0', 'P1')", "lifecycle IN ('confirmed', 'reported') AND severity = 'P2'"))
def findings_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)


@query(gate_sql("lifecycle IN ('confirmed', 'reported') AND confidence <> 'low' AND severity = 'P0'", "lifecycle IN ('confirmed', 'reported') AND confidence <> 'low' AND severity IN ('P0', 'P1', 'P2')"))
def findings_gate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir, mode="block", block_at="P0", minimum="medium")


NEXT = "SELECT id, lifecycle, CASE event_id % 5 WHEN 0 THEN 'corroborated' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'reported' WHEN 3 THEN 'waived' ELSE 'dismissed' END AS next FROM (" + R.FINDINGS + ") f"


@query(f"SELECT n.* FROM ({NEXT}) n LEFT JOIN {R.values([(a, b) for a, t in findings.TRANSITIONS.items() for b in t.split()], 'a, b')} t ON n.lifecycle = t.a AND n.next = t.b WHERE t.a IS NULL")
def findings_illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.illegal_transitions(relation(spark, sf_dir, NEXT))


@query(f"SELECT rule_id, count(*) FILTER (lifecycle IN ('confirmed', 'reported')) AS n_confirmed, count(*) FILTER (lifecycle IN ('corroborated', 'uncertain', 'candidate')) AS n_uncertain, count(*) FILTER (lifecycle = 'dismissed') AS n_dismissed, count(*) FILTER (lifecycle = 'waived') AS n_waived FROM ({R.FINDINGS}) f GROUP BY rule_id")
def findings_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.buckets(relation(spark, sf_dir, R.FINDINGS), "rule_id")


@query(f"SELECT path, start_line, title FROM ({R.FINDINGS}) f WHERE path IS NOT NULL GROUP BY path, start_line, title HAVING count(DISTINCT severity) > 1")
def findings_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.conflicts(relation(spark, sf_dir, R.FINDINGS).where("path is not null"), ["path", "start_line", "title"])


MINOR_CASE = """CASE WHEN stage IN ('security', 'permissions') THEN CASE WHEN t LIKE '%token%' OR t LIKE '%secret%' THEN 'secrets-privacy-logging-retention-deletion' WHEN t LIKE '%injection%' THEN 'input-injection-path-url-file-safety' ELSE 'authentication-authorization-tenant-isolation' END
 WHEN stage = 'concurrency' THEN CASE WHEN t LIKE '%lock%' THEN 'lock-scope-ownership-contention' WHEN t LIKE '%retry%' THEN 'bounded-work-retries-queues-backpressure' ELSE 'race-atomicity-toctou' END WHEN stage = 'testing' THEN CASE WHEN t LIKE '%boundary%' THEN 'failure-boundary-coverage' ELSE 'observable-behavior-coverage' END
 WHEN stage = 'readability' THEN CASE WHEN t LIKE '%try%' THEN 'try-catch-error-boundaries' ELSE 'function-responsibility-size' END WHEN stage = 'data' THEN 'api-event-schema-compatibility' WHEN stage IN ('behavior', 'universal') THEN CASE WHEN t LIKE '%retry%' THEN 'failure-timeout-retry-cancellation' ELSE 'primary-path' END ELSE 'intent-contract' END"""
PLACED = f"(SELECT *, {MINOR_CASE} AS minor_id FROM (SELECT *, lower(concat(title, ' ', evidence)) AS t FROM ({R.FINDINGS}) f) g)"


@query(f"SELECT id, minor_id FROM {PLACED} p")
def findings_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, R.FINDINGS).select("id", findings.minor_of().alias("minor_id"))


@query(f"""SELECT a.entity, a.minor_id, CASE WHEN c.cap IS NOT NULL AND status = 'not_applicable' THEN 'scored' ELSE status END AS status, CASE WHEN c.cap IS NULL OR status = 'not_assessed' THEN half_points WHEN status = 'not_applicable' THEN c.cap ELSE least(half_points, c.cap) END AS half_points,
CASE WHEN c.cap IS NOT NULL AND status = 'not_applicable' THEN {named('c.weakest', findings.CONFIDENCES)} ELSE confidence END AS confidence, CASE WHEN c.cap IS NOT NULL AND status <> 'not_assessed' THEN ids END AS evidence
FROM ({R.SUPPLIER_ASSESSMENTS}) a LEFT JOIN (SELECT user_id % 100 AS entity, minor_id, CAST(min(CASE severity WHEN 'P0' THEN 0 WHEN 'P1' THEN 2 WHEN 'P2' THEN 5 WHEN 'P3' THEN 7 ELSE 9 END) AS INT) AS cap, max({CONF}) AS weakest, list_sort(list(DISTINCT id)) AS ids FROM {PLACED} p WHERE lifecycle = 'confirmed' GROUP BY user_id % 100, minor_id) c ON a.entity = c.entity AND a.minor_id = c.minor_id""")
def score_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relation(spark, sf_dir, R.FINDINGS).where("lifecycle = 'confirmed'").withColumn("minor_id", findings.minor_of()).select((F.col("user_id") % 100).alias("entity"), "minor_id", "severity", "confidence", "id")
    return findings.capped(relation(spark, sf_dir, R.SUPPLIER_ASSESSMENTS), found)


# Detection quality.

LISTS = f"""(SELECT id, list_distinct(e) AS e, list_distinct(h) AS h, coalesce(r, []) AS r, rep, latency_ms, input_tokens, r IS NOT NULL AS seen FROM (SELECT id, list_filter(string_split(expected, ','), lambda x: x <> '') AS e, list_filter(string_split(high, ','), lambda x: x <> '') AS h, list_filter(string_split(reported, ','), lambda x: x <> '') AS r,
 CASE WHEN reported IS NOT NULL THEN list_transform(string_split(repeats, '|'), lambda q: list_sort(list_distinct(list_filter(string_split(q, ','), lambda x: x <> '')))) END AS rep, latency_ms, input_tokens FROM ({R.CASES}) c) x)"""
RESULTS = f"""(SELECT *, CASE WHEN len(missing) = 0 AND len(unexpected) = 0 AND duplicates = 0 THEN 'exact' WHEN n_expected = 0 THEN 'false_positive' WHEN len(missing) = n_expected THEN 'missed' ELSE 'partial' END AS outcome FROM (SELECT id, CAST(len(e) AS INT) AS n_expected, CAST(len(r) AS INT) AS n_reported, list_sort(list_filter(e, lambda x: NOT list_contains(r, x))) AS missing,
 list_sort(list_filter(list_distinct(r), lambda x: NOT list_contains(e, x))) AS unexpected, CAST(len(r) - len(list_distinct(r)) AS INT) AS duplicates, CAST(coalesce(len(list_filter(rep, lambda q: q = list_sort(list_distinct(r)))), 0) AS INT) AS stable, CAST(coalesce(len(rep), 0) AS INT) AS compared, list_sort(list_filter(h, lambda x: NOT list_contains(r, x))) AS high_misses FROM {LISTS} l) y)"""


@query(f"SELECT * FROM {RESULTS} r")
def evaluation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.case_results(relation(spark, sf_dir, R.CASES))


@query(f"""SELECT *, CASE WHEN high_severity_misses > 0 OR false_negatives > 0 THEN 'BLOCK' WHEN false_positives > 0 OR duplicates > 0 OR stability < 1 THEN 'WARN' ELSE 'PASS' END AS gate FROM (SELECT CAST(sum(n_expected - len(missing)) AS BIGINT) AS true_positives, CAST(sum(len(unexpected)) AS BIGINT) AS false_positives, CAST(sum(len(missing)) AS BIGINT) AS false_negatives, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(len(high_misses)) AS BIGINT) AS high_severity_misses,
count(*) FILTER (outcome = 'exact') AS exact_cases, count(*) FILTER (outcome = 'partial') AS partial_cases, count(*) FILTER (outcome = 'missed') AS missed_cases, count(*) FILTER (outcome = 'false_positive') AS false_positive_cases, sum(n_expected - len(missing)) / sum(n_expected - len(missing) + len(unexpected)) AS precision, sum(n_expected - len(missing)) / sum(n_expected) AS recall,
count(*) FILTER (outcome = 'false_positive') / count(*) FILTER (n_expected = 0) AS false_positive_rate, sum(duplicates) / sum(n_reported) AS duplicate_rate, sum(stable) / sum(compared) AS stability FROM {RESULTS} r) z""")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metrics(evaluation.case_results(relation(spark, sf_dir, R.CASES)))


@query(f"SELECT CAST(sum(CASE WHEN latency_ms >= 0 THEN latency_ms ELSE 0 END) AS BIGINT) AS latency_ms, CAST(sum(CASE WHEN input_tokens >= 0 THEN input_tokens ELSE 0 END) AS BIGINT) AS input_tokens FROM {LISTS} l WHERE seen")
def evaluation_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.resources(relation(spark, sf_dir, R.CASES))


@query("SELECT concat('case-', CAST(d.doc_id AS VARCHAR)) AS id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def evaluation_unknown_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.unknown_observations(relation(spark, sf_dir, R.CASES), relation(spark, sf_dir, "SELECT concat('case-', CAST(doc_id AS STRING)) AS id FROM {documents}"))


# Content policy.

PARTS = "string_split(path, '/')"
CLASS = f"""CASE WHEN list_contains({PARTS}, '.git') THEN 'git_metadata' WHEN list_has_any({PARTS}, ['vendor', 'node_modules', '.pnpm-store', 'bower_components']) THEN 'dependency' WHEN list_has_any({PARTS}, ['dist', 'build']) THEN 'generated' WHEN list_has_any({PARTS}, ['__pycache__', '.cache']) THEN 'cache' WHEN path LIKE '%.env%' THEN 'suspected_secret' WHEN path ILIKE '%.png' THEN 'binary' END"""
REASONED = f"(SELECT *, CASE WHEN path LIKE '../%' OR path LIKE '%//%' THEN 'unsafe_path' ELSE {CLASS} END AS reason FROM ({R.CONTENT}) f)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, R.CONTENT)


@query(f"SELECT workspace, ordinal, path, reason FROM {REASONED} r")
def content_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.candidates(files(spark, sf_dir)).select("workspace", "ordinal", "path", "reason")


@query(f"SELECT workspace, reason, count(*) AS n, list(path ORDER BY ordinal) FILTER (nth <= 20) AS first FROM (SELECT *, row_number() OVER (PARTITION BY workspace, reason ORDER BY ordinal) AS nth FROM {REASONED} r WHERE reason IS NOT NULL) x GROUP BY workspace, reason")
def content_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.exclusion_counts(content.candidates(files(spark, sf_dir)), "workspace")


TOUCHED = "SELECT user_id AS review, event_id AS ordinal, concat('src/', event_type, CASE WHEN event_id % 9 = 0 THEN '/auth' WHEN event_id % 9 = 1 THEN '/schema' WHEN event_id % 9 = 2 THEN '/queue' WHEN event_id % 9 = 3 THEN '/perf' ELSE '/plain' END, CAST(event_id % 10 AS STRING), CASE WHEN event_id % 4 = 0 THEN '.tsx' ELSE '.ts' END) AS path FROM {events}"
JOINED = f"(SELECT review, lower(string_agg(path, chr(10) ORDER BY ordinal, path)) AS p FROM ({TOUCHED}) t GROUP BY review)"
FLAGS = ", ".join(f"regexp_matches(p, '{pattern.replace(chr(92) + 'z', '$')}') AS {k}" for k, pattern in content.RISKS.items())


@query(f"SELECT review, {FLAGS} FROM {JOINED} j")
def risk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.risk_signals(relation(spark, sf_dir, TOUCHED), "review")


STAGED = f"""(SELECT review, list_concat(['universal', 'behavior', 'readability', 'testing', 'concurrency'], list_filter([CASE WHEN auth OR crypto THEN 'security' END, CASE WHEN auth THEN 'permissions' END, CASE WHEN sql OR schema THEN 'data' END, CASE WHEN cache THEN 'cache' END, CASE WHEN jobs THEN 'jobs' END, CASE WHEN events THEN 'events' END, CASE WHEN external_api THEN 'external_api' END,
 CASE WHEN performance THEN 'performance' END, CASE WHEN schema THEN 'compatibility' END, CASE WHEN ui THEN 'ui' END], lambda x: x IS NOT NULL)[1:2]) AS stages FROM (SELECT review, {FLAGS} FROM {JOINED} j) s)"""


@query(f"SELECT review, stages FROM {STAGED} s")
def review_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.stages(risk_signals(spark, sf_dir)).select("review", "stages")


ROUTE_ROWS = R.values([(m, i, s) for m, r in content.ROUTES.items() for i, s in enumerate(r.split())], "major_id, nth, stage")


@query(f"SELECT s.review, r.major_id, arg_min(r.stage, r.nth) FILTER (list_contains(s.stages, r.stage)) AS stage FROM {STAGED} s CROSS JOIN {ROUTE_ROWS} r GROUP BY s.review, r.major_id")
def assessment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.assessment_plan(review_stages(spark, sf_dir), "review")


EXPECTED = f"SELECT s_suppkey AS review, major_id AS stage, minor_id FROM {{supplier}} CROSS JOIN {R.MINORS} m"
SAID = f"SELECT s_suppkey AS review, CASE WHEN s_suppkey % 10 = 3 AND minor_no = 4 THEN 'testing' ELSE major_id END AS stage, minor_id, 'scored' AS status, CAST((s_suppkey + minor_no) % 11 AS INT) AS half_points FROM {{supplier}} CROSS JOIN {R.MINORS} m WHERE (s_suppkey + minor_no) % 13 > 0 UNION ALL SELECT s_suppkey, 'security', 'input-injection-path-url-file-safety', 'scored', 4 FROM {{supplier}} WHERE s_suppkey % 6 = 1"


@query(f"""WITH e AS ({EXPECTED}), s AS ({SAID}), v AS (SELECT DISTINCT s.review, s.stage FROM s LEFT JOIN e ON e.review = s.review AND e.stage = s.stage AND e.minor_id = s.minor_id WHERE e.review IS NULL), n AS (SELECT review, stage, minor_id, count(*) AS n, min(status) AS status, min(half_points) AS half_points FROM s GROUP BY review, stage, minor_id)
SELECT e.review, e.stage, e.minor_id, CASE WHEN n.n = 1 AND v.review IS NULL THEN n.status ELSE 'not_assessed' END AS status, CASE WHEN n.n = 1 AND v.review IS NULL THEN n.half_points END AS half_points FROM e LEFT JOIN n ON n.review = e.review AND n.stage = e.stage AND n.minor_id = e.minor_id LEFT JOIN v ON v.review = e.review AND v.stage = e.stage""")
def stage_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.stage_assessments(relation(spark, sf_dir, EXPECTED), relation(spark, sf_dir, SAID))


HAVE = f"SELECT workspace, concat(path, CASE WHEN ordinal % 31 = 0 THEN '.old' ELSE '' END) AS path FROM ({R.CONTENT}) c"


@query(f"WITH e AS (SELECT DISTINCT workspace, path FROM ({R.CONTENT}) c WHERE status <> 'deleted' AND NOT is_binary), h AS (SELECT DISTINCT * FROM ({HAVE}) x) SELECT *, 'missing' AS issue FROM (SELECT * FROM e EXCEPT SELECT * FROM h) a UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM h EXCEPT SELECT * FROM e) b")
def content_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.content_mismatch(files(spark, sf_dir), relation(spark, sf_dir, HAVE))


SECRETS = "SELECT doc_id, concat(text, CASE WHEN doc_id % 7 = 0 THEN ' PassWord: \"abcdefgh_ijkl-mnop\"' WHEN doc_id % 7 = 1 THEN ' -----BEGIN RSA PRIVATE KEY-----' ELSE '' END) AS text FROM {documents}"


@query(f"SELECT doc_id, regexp_matches(text, '-----BEGIN (OPENSSH |EC |RSA )?PRIVATE KEY-----') OR regexp_matches(text, '(?i)(token|password|secret|api[_-]?key)\\s*[=:]\\s*[''\"]?[\\w-]{{16,}}') AS secret FROM ({SECRETS}) s".replace("{{16,}}", "{16,}"))
def content_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, SECRETS).select("doc_id", content.looks_secret(F.col("text")).alias("secret"))


@query("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN true WHEN user_id % 3 = 1 THEN user_id % 2 = 0 ELSE false END AS allowed FROM events GROUP BY user_id")
def egress_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = relation(spark, sf_dir, "SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END AS classification, CASE WHEN user_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS consent FROM {events}")
    return content.egress(asked).select("user_id", "allowed")


# Ordered folds. The SQL walks the files with recursion.

SIZED = f"SELECT workspace, ordinal, octet_length(encode(content, 'utf-8')) AS size, CASE WHEN ordinal % 9 = 4 THEN 'binary' END AS reason, ordinal % 9 = 4 AS broken FROM ({R.CONTENT}) c"
SIZED_DUCK = SIZED.replace("octet_length(encode(content, 'utf-8'))", "CAST(strlen(content) AS BIGINT)")
WALK = "WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY ordinal) AS nth FROM ({sized}) s), w AS ({first} UNION ALL {step}) {out}"


def walk(decide: str, out: str, uses: str = "outcome = 'kept'") -> str:
    take = f"(SELECT f.workspace, f.ordinal, f.nth, f.size, f.reason, p.used, p.n FROM f JOIN {{prior}} p ON p.workspace = f.workspace AND f.nth = p.nth + 1)"
    body = f"SELECT workspace, nth, ordinal, outcome, used + CASE WHEN {uses} THEN size ELSE 0 END AS used, n + CASE WHEN {uses} THEN 1 ELSE 0 END AS n FROM (SELECT *, {decide} AS outcome FROM {{take}} t) d"
    first = body.replace("{take}", take.replace("{prior}", "(SELECT DISTINCT workspace, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n FROM f)"))
    return WALK.replace("{sized}", SIZED_DUCK).replace("{first}", first).replace("{step}", body.replace("{take}", take.replace("{prior}", "w"))).replace("{out}", out)


CAPTURE = "CASE WHEN nth > 200 THEN 'file_limit' WHEN reason IS NOT NULL THEN reason WHEN 100000 - used < 1 THEN 'aggregate_byte_limit' WHEN size > least(100000 - used, 20000) THEN CASE WHEN 100000 - used >= 20000 THEN 'file_limit' ELSE 'aggregate_byte_limit' END ELSE 'kept' END"


@query(walk(CAPTURE, "SELECT workspace, ordinal, outcome FROM w"))
def greedy_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.greedy_capture(relation(spark, sf_dir, SIZED), max_files=200, max_file_bytes=20_000, max_bytes=100_000)


SELECT = "CASE WHEN n >= 60 THEN 'aggregate_file_limit' WHEN size > 9000 THEN 'file_limit' WHEN used + size > 120000 THEN 'aggregate_byte_limit' WHEN reason IS NOT NULL THEN reason ELSE 'selected' END"


@query(walk(SELECT, "SELECT workspace, ordinal, outcome FROM w", "outcome = 'selected'"))
def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.greedy_select(relation(spark, sf_dir, SIZED).withColumnRenamed("reason", "flaw"), max_files=60, max_file_bytes=9000, max_bytes=120_000)


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY ordinal) AS nth FROM ({SIZED_DUCK}) s), c AS (SELECT workspace, ordinal, nth, CASE WHEN NOT broken THEN size END AS size, CASE WHEN NOT broken THEN least(size, 20000) END AS capped FROM f WHERE nth <= 40), r AS (SELECT *, least(100000, coalesce(sum(capped) OVER (PARTITION BY workspace ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS used FROM c)
SELECT workspace, ordinal, CAST(CASE WHEN used < 100000 AND size IS NOT NULL THEN least(capped, 100000 - used) END AS BIGINT) AS taken, coalesce(CASE WHEN used < 100000 AND size IS NOT NULL THEN least(capped, 100000 - used) END < size, false) AS truncated FROM r""")
def review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.context(relation(spark, sf_dir, SIZED).withColumn("size", F.when(~F.col("broken"), F.col("size"))), max_file_bytes=20_000, max_bytes=100_000)


@query(walk("CASE WHEN n < 50 AND size <= 15000 AND used + size <= 60000 AND reason IS NULL THEN 'kept' ELSE 'out' END", "SELECT workspace, ordinal FROM w WHERE outcome = 'kept'"))
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.newest_runs(relation(spark, sf_dir, SIZED).withColumn("age_rank", F.col("ordinal")), "workspace", 50, 15_000, 60_000)


AGED = f"SELECT workspace, ordinal, ordinal % 101 AS age, ordinal % 40 = 6 AS artifact FROM ({R.CONTENT}) c"


@query(f"SELECT workspace, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY artifact DESC, age, ordinal) AS nth, count(*) OVER (PARTITION BY workspace) AS total, count(*) FILTER (artifact) OVER (PARTITION BY workspace) AS a FROM ({AGED}) g) x WHERE nth <= least(greatest(total + 1 - 120, a), 32)")
def ledger_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.eviction(relation(spark, sf_dir, AGED), "workspace", 120)


LATEST = f"SELECT workspace, CASE WHEN workspace = 'de' THEN 12 WHEN workspace = 'fr' THEN 0 ELSE 500 END AS incoming_age FROM ({R.CONTENT}) c GROUP BY workspace"


@query(f"""WITH g AS (SELECT a.*, count(*) OVER (PARTITION BY workspace) AS total, count(*) FILTER (artifact) OVER (PARTITION BY workspace) AS a FROM ({AGED}) a), n AS (SELECT g.*, row_number() OVER (PARTITION BY g.workspace ORDER BY artifact DESC, age, ordinal) AS nth FROM g JOIN ({LATEST}) l ON g.workspace = l.workspace WHERE artifact OR age < incoming_age)
SELECT t.workspace, count(n.nth) AS removed, any_value(t.total) + 1 - count(n.nth) <= 240 AS accepted FROM (SELECT DISTINCT workspace, total FROM g) t LEFT JOIN n ON n.workspace = t.workspace AND nth <= least(greatest(n.total + 1 - 240, n.a), 32) GROUP BY t.workspace""")
def ledger_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.run_capacity(relation(spark, sf_dir, AGED), "workspace", 240, relation(spark, sf_dir, LATEST))


CACHED = f"SELECT workspace, row_number() OVER (PARTITION BY workspace ORDER BY ordinal) AS age_rank, CASE WHEN ordinal % 50 = 3 THEN 700 ELSE 100 END AS age_ms, octet_length(encode(content, 'utf-8')) AS size, ordinal % 40 = 6 AS artifact FROM ({R.CONTENT}) c WHERE content IS NOT NULL"
CACHED_DUCK = CACHED.replace("octet_length(encode(content, 'utf-8'))", "CAST(strlen(content) AS BIGINT)")
COMING = f"SELECT workspace, 5000 AS bytes FROM ({R.CONTENT}) c GROUP BY workspace"
GOES = "(p.gone < 20 AND (artifact OR age_ms > 600 OR p.entries > 200 OR p.used > 150000))"


@query(f"""WITH RECURSIVE f AS (SELECT * FROM ({CACHED_DUCK}) x), s AS (SELECT workspace, CAST(0 AS BIGINT) AS age_rank, count(*) + 1 AS entries, CAST(sum(size) + 5000 AS BIGINT) AS used, CAST(0 AS BIGINT) AS gone, false AS removed FROM f GROUP BY workspace),
w AS (SELECT * FROM s UNION ALL SELECT f.workspace, f.age_rank, p.entries - CAST({GOES} AS INT), p.used - CASE WHEN {GOES} THEN f.size ELSE 0 END, p.gone + CAST({GOES} AS INT), {GOES} FROM f JOIN w p ON p.workspace = f.workspace AND f.age_rank = p.age_rank + 1)
SELECT workspace, age_rank FROM w WHERE removed""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = relation(spark, sf_dir, COMING)
    return selection.cache_capacity(relation(spark, sf_dir, CACHED), "workspace", incoming, 200, 150_000, 600, 20).select("workspace", "age_rank")


DIAGNOSTICS = "SELECT user_id % 20 AS run, event_id AS arrival, concat('doc/', CAST(user_id % 7 AS STRING)) AS path, CASE WHEN event_id % 50 = 0 THEN 'SIZE_LIMIT_EXCEEDED' ELSE upper(event_type) END AS code FROM {events}"
SENTINEL = "CASE WHEN n > 25 AND {at} = 25 THEN {new} ELSE {old} END"


def sentinel(at: str) -> str:
    return ", ".join(SENTINEL.replace("{at}", at).replace("{new}", v).replace("{old}", c) + f" AS {c}" for c, v in (("path", "'.'"), ("code", "'DIAGNOSTIC_LIMIT_EXCEEDED'")))


@query(f"SELECT run, CAST(o AS INT) AS ordinal, {sentinel('o')} FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY path, code, arrival) AS o, count(*) OVER (PARTITION BY run) AS n FROM ({DIAGNOSTICS}) d) x WHERE o <= 25")
def diagnostics_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.bounded_diagnostics(relation(spark, sf_dir, DIAGNOSTICS), "run", 25)


@query(f"SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY code = 'DIAGNOSTIC_LIMIT_EXCEEDED', path, code, arrival) AS INT) AS ordinal, path, code FROM (SELECT run, arrival, {sentinel('o')} FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY arrival) AS o, count(*) OVER (PARTITION BY run) AS n FROM ({DIAGNOSTICS}) d) x WHERE o <= 25) y")
def diagnostics_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.arrival_diagnostics(relation(spark, sf_dir, DIAGNOSTICS), "run", 25)


@query(f"SELECT run, arrival, row_number() OVER (PARTITION BY run ORDER BY code, path, arrival) <= 10 AS kept FROM ({DIAGNOSTICS}) d")
def retain_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.smallest(relation(spark, sf_dir, DIAGNOSTICS), "run", ["code", "path", "arrival"], 10).select("run", "arrival", "kept")


STATUS = """SELECT run, code FROM (SELECT user_id % 40 AS run, CASE (user_id % 40) % 5 WHEN 0 THEN 'CONFIG_READ_FAILED' WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 'SIZE_LIMIT_EXCEEDED' ELSE 'WAIVER_LOCATION_CHANGED' END
WHEN 2 THEN CASE WHEN event_id % 7 = 0 THEN 'PROFILE_UNKNOWN_KEY' ELSE 'DIAGNOSTIC_LIMIT_EXCEEDED' END WHEN 3 THEN 'RULE_DUPLICATE' END AS code FROM {events}) c WHERE code IS NOT NULL"""


@query(f"""SELECT g.run, CASE WHEN count(code) = 0 THEN 'PASS' WHEN count(code) > count(code) FILTER (cut) THEN 'BLOCK' ELSE 'INCOMPLETE' END AS gate, count(code) > count(code) FILTER (cut) AS invalid
FROM (SELECT DISTINCT user_id % 40 AS run FROM {{events}}) g LEFT JOIN (SELECT *, code IN ('CONFIG_READ_FAILED', 'WAIVER_LOCATION_CHANGED') OR code LIKE '%!_LIMIT!_EXCEEDED' ESCAPE '!' AS cut FROM ({STATUS}) s) d ON d.run = g.run GROUP BY g.run""")
def diagnostics_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.diagnostics_status(relation(spark, sf_dir, STATUS), "run", relation(spark, sf_dir, "SELECT user_id % 40 AS run FROM {events}"))


# Policy.

WAIVERS = R.values([
    ("w1", "repo-1", "click", 1, 3, "src/**", None, "2026-01-01T00:00:00Z", "2026-12-31T00:00:00Z", "accepted for the migration"), ("w2", "repo-1", "view", 2, 2, "src/*", None, "2026-01-01T00:00:00Z", "2026-12-31T00:00:00Z", "accepted for the migration"),
    ("w3", "repo-0", "purchase", 1, 9, None, "f-12|f-40|f-7", "2026-01-01T00:00:00Z", "2027-12-31T00:00:00Z", "accepted for the migration"), ("w4", "repo-2", "click", 1, 9, "src/m5.ts|src/m8.ts", None, "2026-02-30T00:00:00Z", "2026-12-31T00:00:00Z", "short"),
    ("w5", "repo-2", "view", 4, 1, None, None, "2026-01-01T00:00:00Z", "2026-03-01T00:00:00Z", "accepted for the migration"), ("w6", "repo-0", "click", 1, 9, None, None, "2026-01-01T00:00:00Z", "2026-11-01T00:00:00Z", "accepted for the migration"), ("w6", "repo-0", "view", 1, 9, "src/**", None, "2026-08-01T00:00:00Z", "2026-07-31T00:00:00Z", "accepted for the migration"),
], "waiver_id, repository, rule_id, minimum, maximum, paths, findings, created_at, expires_at, reason")
NOW = "2026-06-15 00:00:00"
FACED = f"SELECT id AS context_id, id AS finding_id, concat('repo-', CAST(user_id % 3 AS STRING)) AS repository, rule_id, event_id % 4 + 1 AS rule_version, path FROM ({R.FINDINGS}) f"


def waivers(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {WAIVERS}").withColumns({c: F.split(c, "\\|") for c in ("paths", "findings")})


GLOB = "(p = c.path OR (p LIKE '%/**' AND (c.path = p[:-4] OR starts_with(c.path, p[:-3]))) OR (p LIKE '%/*' AND p NOT LIKE '%/**' AND starts_with(c.path, p[:-2]) AND NOT contains(substring(c.path, length(p)), '/')))"


@query(f"""SELECT c.context_id, w.waiver_id FROM ({FACED}) c JOIN {WAIVERS} w ON c.repository = w.repository AND c.rule_id = w.rule_id AND c.rule_version BETWEEN w.minimum AND w.maximum
WHERE TRY_CAST(w.created_at AS TIMESTAMP) <= TIMESTAMP '{NOW}' AND TRY_CAST(w.expires_at AS TIMESTAMP) > TIMESTAMP '{NOW}' AND (w.findings IS NULL OR list_contains(string_split(w.findings, '|'), c.finding_id))
AND (w.paths IS NULL OR (c.path IS NOT NULL AND len(list_filter(string_split(w.paths, '|'), lambda p: {GLOB})) > 0))""")
def waivers_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.applicable_waivers(relation(spark, sf_dir, FACED), waivers(spark), NOW)


@query(f"""WITH w AS (SELECT *, TRY_CAST(created_at AS TIMESTAMP) AS c, TRY_CAST(expires_at AS TIMESTAMP) AS e, count(*) OVER (PARTITION BY waiver_id) AS n FROM {WAIVERS} v)
SELECT DISTINCT waiver_id, issue FROM (SELECT waiver_id, unnest([CASE WHEN c IS NULL THEN 'created_invalid' END, CASE WHEN e IS NULL THEN 'expires_invalid' END, CASE WHEN e <= c THEN 'expires_before_created' END, CASE WHEN c > TIMESTAMP '{NOW}' THEN 'created_in_future' END, CASE WHEN e <= TIMESTAMP '{NOW}' THEN 'expired' END, CASE WHEN date_diff('day', c, e) > 366 THEN 'lifetime_too_long' END, CASE WHEN minimum > maximum THEN 'version_range' END, CASE WHEN n > 1 THEN 'duplicate_id' END, CASE WHEN length(trim(reason)) < 12 THEN 'blank_reason' END]) AS issue FROM w) x WHERE issue IS NOT NULL""")
def waiver_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.waiver_issues(waivers(spark), NOW)


SETTINGS = """SELECT user_id, concat('/budgets/', CASE event_id % 3 WHEN 0 THEN 'concurrency' WHEN 1 THEN 'attempts' ELSE 'files' END) AS pointer, CAST(event_id % 40 AS STRING) AS value, max(event_id % 5) + 1 AS precedence,
CASE max(event_id % 5) WHEN 0 THEN 'built-in-defaults' WHEN 1 THEN 'user-defaults' WHEN 2 THEN 'rule-pack' WHEN 3 THEN 'repository-profile' ELSE 'invocation' END AS source FROM {events} WHERE event_id % 8 < 6 GROUP BY user_id, event_id"""
LAYERS = f"SELECT user_id, pointer, max(value) AS value, precedence, source FROM ({SETTINGS}) s GROUP BY user_id, pointer, precedence, source"
EFFECTIVE = f"(SELECT user_id, pointer, arg_max(value, precedence) AS value, arg_max(source, precedence) AS source FROM ({LAYERS}) l GROUP BY user_id, pointer)"


@query(f"SELECT user_id, pointer, CASE WHEN pointer = '/budgets/concurrency' AND CAST(value AS INT) > 2 THEN '2' WHEN pointer = '/budgets/attempts' AND CAST(value AS INT) > 16 THEN '16' ELSE value END AS value, CASE WHEN (pointer = '/budgets/concurrency' AND CAST(value AS INT) > 2) OR (pointer = '/budgets/attempts' AND CAST(value AS INT) > 16) THEN 'safety-invariants' ELSE source END AS source FROM {EFFECTIVE} e")
def policy_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.safe(policy.overlay(relation(spark, sf_dir, LAYERS), "user_id"), {"/budgets/concurrency": 2, "/budgets/attempts": 16})


RULES = "SELECT p_type AS rule_id, p_brand AS pack, p_partkey AS ordinal, p_name AS title FROM {part}"


@query(f"SELECT rule_id, arg_min(pack, ordinal) AS pack, min(ordinal) AS ordinal, arg_min(title, ordinal) AS title, count(*) - 1 AS repeated FROM ({RULES}) r GROUP BY rule_id")
def rule_pack_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.first_definitions(relation(spark, sf_dir, RULES))


@query("SELECT DISTINCT p_brand AS rule_id FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def unknown_rule_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.unknown_overrides(relation(spark, sf_dir, "SELECT DISTINCT p_brand AS rule_id FROM {part}"), relation(spark, sf_dir, "SELECT DISTINCT p_brand AS rule_id FROM {part} WHERE p_size > 48"))


CATALOG = R.values([("BUILDING", "a|b"), ("MACHINERY", "c"), ("FURNITURE", "a")], "provider, models")
CHOSEN = "SELECT c_custkey AS selection_id, c_mktsegment AS provider, CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'c' END AS model, CASE WHEN c_custkey % 4 = 2 OR c_custkey % 12 = 0 THEN 'fast' END AS model_policy FROM {customer}"


@query(f"SELECT * FROM (SELECT selection_id, CASE WHEN models IS NULL THEN 'untrusted_provider' WHEN (model IS NULL) = (model_policy IS NULL) THEN 'model_or_policy' WHEN model IS NOT NULL AND NOT list_contains(string_split(models, '|'), model) THEN 'model_not_allowed' END AS issue FROM ({CHOSEN}) s LEFT JOIN {CATALOG} c ON s.provider = c.provider) x WHERE issue IS NOT NULL")
def provider_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.provider_issues(relation(spark, sf_dir, CHOSEN), spark.sql(f"SELECT * FROM {CATALOG}").withColumn("models", F.split("models", "\\|")))


GATES = "SELECT user_id, CASE event_id % 6 WHEN 0 THEN 'WARN' WHEN 1 THEN CASE WHEN user_id % 4 = 0 THEN 'BLOCK' ELSE 'WARN' END WHEN 2 THEN CASE WHEN user_id % 5 = 0 THEN 'INCOMPLETE' ELSE 'PASS' END ELSE 'PASS' END AS gate FROM {events}"


@query(f"SELECT user_id, CASE r WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' WHEN 2 THEN 'INCOMPLETE' ELSE 'BLOCK' END AS gate, CAST(CASE r WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS INT) AS exit_code FROM (SELECT user_id, max(CASE gate WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 WHEN 'INCOMPLETE' THEN 2 ELSE 3 END) AS r FROM ({GATES}) g GROUP BY user_id) x")
def strongest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.exit_code(policy.strongest_gate(relation(spark, sf_dir, GATES), "user_id"))


ENDS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'WARN' WHEN 2 THEN 'PASS' ELSE 'INCOMPLETE' END AS gate, o_orderkey % 9 = 0 AS incomplete, CASE o_custkey % 5 WHEN 0 THEN 'INCOMPLETE' WHEN 1 THEN 'BLOCK' WHEN 2 THEN 'PASS' END AS score_gate FROM {orders}"


@query(f"SELECT id, CAST(CASE WHEN incomplete OR gate = 'INCOMPLETE' OR coalesce(score_gate, '') = 'INCOMPLETE' THEN 3 WHEN gate = 'BLOCK' THEN 1 ELSE 0 END AS INT) AS exit_code FROM ({ENDS}) e")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.exit_code(relation(spark, sf_dir, ENDS)).select("id", "exit_code")


COMMENTS = """SELECT event_id AS comment_id, concat(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('Intro', chr(10)) ELSE concat('<!-- report:cut', chr(13), chr(10)) END,
CASE WHEN event_id % 19 = 0 THEN '' ELSE concat('<!-- report:hub:org/app-', CAST(user_id % 30 AS STRING), ':', CAST(user_id % 3 AS STRING), ':', CAST(event_id % 4 AS STRING), ':h', CAST(event_id % 5 AS STRING), ' -->') END,
CASE WHEN event_id % 4 = 1 THEN concat(chr(10), '<!-- report:hub:org/app-1:1:0:h0 -->') ELSE '' END, chr(10), 'text') AS body FROM {events} WHERE event_id % 5 = 0"""
WANTED = "SELECT DISTINCT concat('hub:org/app-', CAST(user_id % 40 AS STRING), ':', CAST(user_id % 3 AS STRING)) AS scope, CAST(user_id % 4 AS STRING) AS head_sha, concat('h', CAST(user_id % 5 AS STRING)) AS report_hash FROM {events} WHERE user_id < 60"
MARKER = r"(?m)^(<!-- report:.* -->)\r?$"


@query(f"""WITH c AS (SELECT comment_id, regexp_extract(body, '{MARKER}', 1) AS marker FROM ({COMMENTS}) x), w AS (SELECT *, '<!-- report:' || scope || ':' AS prefix, '<!-- report:' || scope || ':' || head_sha || ':' || report_hash || ' -->' AS expected FROM ({WANTED}) y)
SELECT scope, CASE WHEN min(comment_id) IS NULL THEN 'created' WHEN bool_or(marker = expected) THEN 'reused' ELSE 'updated' END AS action, coalesce(min(comment_id) FILTER (marker = expected), min(comment_id)) AS comment_id
FROM w LEFT JOIN c ON starts_with(marker, prefix) GROUP BY scope, expected""")
def publication_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.publication_action(relation(spark, sf_dir, COMMENTS), relation(spark, sf_dir, WANTED))


# Evidence.

CHUNK = "SELECT doc_id AS patch_id, concat('--- a/old', CAST(doc_id % 9 AS STRING), '.ts', chr(10), '+++ b/m', CAST(doc_id % 9 AS STRING), '.ts', chr(10), '@@ -', CAST(doc_id % 7 + 1 AS STRING), ',4 +', CAST(doc_id % 5 + 3 AS STRING), ',5 @@', chr(10), ' ', replace(left(text, 40), chr(10), ' '), chr(10), '-', replace(substring(text, 41, 30), chr(10), ' '), chr(10), '+', replace(substring(text, 71, 30), chr(10), ' '), chr(10), '+  added by ', source, chr(10), ' end ', lang, CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), '@@ -40,2 +41,1 @@', chr(10), '-gone', chr(10), ' stays') ELSE '' END) AS diff FROM {documents}"
#: The same lines straight from the documents, without reading a patch.
LINES = """SELECT patch_id, side, path, CAST(line AS INT) AS line, content, changed FROM (
SELECT doc_id AS patch_id, unnest([{{'side': 'old', 'path': 'old' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': doc_id % 7 + 1, 'content': a, 'changed': false}}, {{'side': 'old', 'path': 'old' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': doc_id % 7 + 2, 'content': b, 'changed': true}}, {{'side': 'old', 'path': 'old' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': doc_id % 7 + 3, 'content': z, 'changed': false}},
{{'side': 'new', 'path': 'm' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': doc_id % 5 + 3, 'content': a, 'changed': false}}, {{'side': 'new', 'path': 'm' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': doc_id % 5 + 4, 'content': c, 'changed': true}}, {{'side': 'new', 'path': 'm' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': doc_id % 5 + 5, 'content': '  added by ' || source, 'changed': true}}, {{'side': 'new', 'path': 'm' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': doc_id % 5 + 6, 'content': z, 'changed': false}},
CASE WHEN doc_id % 3 = 0 THEN {{'side': 'old', 'path': 'old' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': 40, 'content': 'gone', 'changed': true}} END, CASE WHEN doc_id % 3 = 0 THEN {{'side': 'old', 'path': 'old' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': 41, 'content': 'stays', 'changed': false}} END, CASE WHEN doc_id % 3 = 0 THEN {{'side': 'new', 'path': 'm' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 'line': 41, 'content': 'stays', 'changed': false}} END], recursive := true)
FROM (SELECT *, replace(left(text, 40), chr(10), ' ') AS a, replace(substring(text, 41, 30), chr(10), ' ') AS b, replace(substring(text, 71, 30), chr(10), ' ') AS c, 'end ' || lang AS z FROM documents) d) x WHERE side IS NOT NULL""".replace("{{", "{").replace("}}", "}")


@query()
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.diff_lines(relation(spark, sf_dir, CHUNK))


SQL["diff_lines"] = LINES
SNAPSHOT = "SELECT doc_id AS patch_id, concat('m', CAST(doc_id % 9 AS STRING), '.ts') AS path, concat('old', CAST(doc_id % 9 AS STRING), '.ts') AS previous_path, CASE WHEN doc_id % 4 = 0 THEN 'renamed' WHEN doc_id % 4 = 1 THEN 'added' ELSE 'modified' END AS status FROM {documents}"


@query()
def diff_lines_in_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.snapshot_paths(diff_lines(spark, sf_dir), relation(spark, sf_dir, SNAPSHOT))


SQL["diff_lines_in_snapshot"] = f"SELECT patch_id, side, replace(path, 'old', 'm') AS path, line, content, changed FROM ({LINES}) l"
#: Candidates that quote the added lines, some wrongly, beyond the patch or with another severity for the same place.
QUOTED = """SELECT doc_id * 10 + k AS candidate_id, doc_id AS patch_id, CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 31 = 1 THEN 'nowhere.ts' ELSE concat('m', CAST(doc_id % 9 AS STRING), '.ts') END AS path, CAST(CASE WHEN doc_id % 31 = 2 THEN 0 ELSE doc_id % 5 + 5 END AS INT) AS start_line, CAST(CASE WHEN doc_id % 31 = 3 THEN 900 WHEN doc_id % 31 = 4 THEN doc_id % 5 + 7 ELSE doc_id % 5 + 6 END AS INT) AS end_line,
concat('Title ', CASE WHEN k = 1 THEN 'A' ELSE 'a' END) AS title, CASE WHEN doc_id % 11 = 5 AND k = 1 THEN 'P3' WHEN doc_id % 2 = 0 THEN 'P1' ELSE 'P2' END AS severity, CASE WHEN doc_id % 31 = 5 THEN 'added' WHEN doc_id % 31 = 6 THEN 'added by somebody' ELSE concat(chr(9), 'added by ', source, '  ', chr(13), chr(10), 'end ', lang) END AS quote, CASE WHEN doc_id % 6 = 0 THEN 'deterministic' END AS fact_kind, CASE WHEN doc_id % 12 = 0 THEN 'a test fails there' ELSE 'brief' END AS fact
FROM {documents} CROSS JOIN (VALUES (1), (2)) AS t(k)"""


@query(f"""WITH q AS (SELECT *, patch_id % 31 AS z FROM ({QUOTED}) c), d AS (SELECT patch_id FROM q GROUP BY patch_id HAVING count(DISTINCT severity) > 1), r AS (SELECT q.*, d.patch_id IS NOT NULL AS disputed, CASE z WHEN 0 THEN 'incomplete' WHEN 1 THEN 'path_unknown' WHEN 2 THEN 'range_invalid' WHEN 3 THEN 'range_too_long' WHEN 4 THEN 'no_match' WHEN 5 THEN 'quote_short' WHEN 6 THEN 'no_match' ELSE 'matched_diff' END AS why FROM q LEFT JOIN d ON q.patch_id = d.patch_id),
s AS (SELECT *, CASE WHEN disputed OR why <> 'matched_diff' THEN 'uncertain' WHEN severity = 'P1' AND NOT (fact_kind IS NOT NULL AND length(fact) >= 12) THEN 'corroborated' ELSE 'confirmed' END AS lifecycle FROM r)
SELECT candidate_id, lifecycle, CASE WHEN lifecycle = 'confirmed' THEN 'high' ELSE 'low' END AS confidence, CASE WHEN why = 'matched_diff' THEN 'new' ELSE 'unknown' END AS disposition, lifecycle = 'corroborated' AS unresolved, CASE WHEN disputed THEN 'conflict' ELSE why END AS reason FROM s""")
def candidates_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = relation(spark, sf_dir, "SELECT doc_id AS patch_id, 'other.ts' AS path, text AS content FROM {documents}")
    return evidence.verified(relation(spark, sf_dir, QUOTED), diff_lines(spark, sf_dir), contents, relation(spark, sf_dir, SNAPSHOT))


# Readability.

UNITS = """SELECT l_orderkey % 500 AS file_id, CASE l_linenumber % 7 WHEN 0 THEN 'file' WHEN 1 THEN 'try' ELSE 'function' END AS kind, CASE WHEN l_orderkey % 97 = 0 AND l_linenumber < 4 THEN 'same' ELSE concat('s', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS symbol_id, CAST((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey * 10 + l_suppkey % 10 AS BIGINT) AS offset,
CAST(CASE WHEN l_linenumber % 7 = 0 THEN l_quantity * 30 ELSE l_quantity * 8 END + {shift} AS INT) AS lines, CAST((l_partkey + {turn}) % 4 AS INT) AS ternary_depth, CAST((l_partkey + {turn}) % 5 AS INT) AS nullish_values, CAST(l_suppkey % 3 AS INT) AS nullish_sources, CAST(CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END AS INT) AS mixed, CAST((l_partkey + {turn}) % 3 AS INT) AS state_keys, CAST(l_partkey % 6 AS INT) AS state_variants,
CAST((l_suppkey + {turn}) % 10 AS INT) AS result_properties, CAST(l_partkey % 3 AS INT) AS result_shapes, CAST(CASE WHEN l_partkey % 29 = 0 THEN 1 + (l_suppkey + {turn}) % 3 ELSE 0 END AS INT) AS error_string_tests, CAST(l_quantity * 3 AS INT) - {shift} AS outcome_distance, CAST(l_partkey % 4 AS INT) AS decisions, CAST(l_suppkey % 3 AS INT) AS awaits, CAST(l_suppkey % 5 AS INT) AS returns FROM {lineitem}"""
NOW_UNITS, OLD_UNITS = UNITS.replace("{shift}", "0").replace("{turn}", "0"), UNITS.replace("{shift}", "CAST(l_partkey % 3 AS INT) - 1").replace("{turn}", "l_orderkey % 3") + " WHERE l_shipdate < TIMESTAMP '1997-01-01 00:00:00'"
BEFORE = ["lines", *readability.MEASURES]
BOTH = f"(SELECT n.*, {', '.join(f'o.{m} AS old_{m}' for m in BEFORE)} FROM ({NOW_UNITS}) n LEFT JOIN (SELECT file_id, kind, symbol_id, {', '.join(f'arg_min({m}, {chr(34)}offset{chr(34)}) AS {m}' for m in BEFORE)} FROM ({OLD_UNITS}) b GROUP BY file_id, kind, symbol_id) o ON n.file_id = o.file_id AND n.kind = o.kind AND n.symbol_id = o.symbol_id)"


def class_sql(*names: str) -> str:
    """How a unit's measures changed, by the rule: any that grew, else any that shrank."""
    some = lambda sign: " OR ".join(f"{n} {sign} old_{n}" for n in names)
    return f"CASE WHEN old_lines IS NULL THEN 'new' WHEN {some('>')} THEN 'expanded' WHEN {some('<')} THEN 'improved' ELSE 'unchanged' END"


SIZE_CLASS = class_sql("lines")
LARGE = f"(lines > 150 AND {SIZE_CLASS} IN ('new', 'expanded'))"
HARD = "(old_lines IS NULL AND lines > 300)"


def rule_sql(rule: str, test: str, severity: str, kind: str, block: str) -> str:
    return f"SELECT file_id, symbol_id, \"offset\", '{rule}' AS rule_id, {severity} AS severity, {kind} AS class, CASE WHEN {block} THEN 'block' ELSE 'warn' END AS impact FROM b WHERE {test}"


FOUND = f"WITH b AS (SELECT * FROM {BOTH} x) " + " UNION ALL ".join(
    rule_sql(*r)
    for r in (
        ("CQ-READ-001", "kind = 'function' AND lines > 80", f"CASE WHEN {HARD} THEN 'P1' WHEN {LARGE} THEN 'P2' ELSE 'P3' END", SIZE_CLASS, f"{HARD} OR {LARGE}"),
        ("CQ-READ-002", "kind = 'file' AND lines > 600 AND old_lines IS NULL", "CASE WHEN lines > 1000 THEN 'P1' ELSE 'P3' END", "'new'", "lines > 1000"),
        ("CQ-READ-003", "kind = 'try' AND lines > 80", f"CASE WHEN {LARGE} THEN 'P2' ELSE 'P3' END", SIZE_CLASS, LARGE),
        ("CQ-READ-004", "kind = 'function' AND (ternary_depth >= 2 OR mixed > 0 OR (nullish_values >= 3 AND nullish_sources >= 2))", "'P3'", class_sql("ternary_depth", "nullish_values", "nullish_sources", "mixed"), "false"),
        ("CQ-READ-005", "kind = 'function' AND state_keys > 0 AND state_variants >= 3", "'P3'", class_sql("state_keys", "state_variants"), "false"),
        ("CQ-READ-006", "kind = 'function' AND (result_properties >= 8 OR result_shapes >= 2)", "'P3'", class_sql("result_properties", "result_shapes"), "false"),
        ("CQ-READ-007", "kind = 'function' AND error_string_tests > 0", "'P3'", class_sql("error_string_tests"), "false"),
        ("CQ-READ-008", "kind = 'function' AND outcome_distance > 80 AND decisions > 0 AND awaits > 0 AND returns > 0", "'P3'", class_sql("outcome_distance", "decisions", "awaits", "returns"), "false"),
    )
)


@query(FOUND)
def readability_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.candidates(relation(spark, sf_dir, NOW_UNITS), relation(spark, sf_dir, OLD_UNITS))


REPEATED = f"(SELECT file_id, kind, symbol_id FROM ({NOW_UNITS}) u GROUP BY file_id, kind, symbol_id HAVING count(*) > 1)"


@query(f"SELECT * FROM {REPEATED} r")
def readability_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.identity_issues(relation(spark, sf_dir, NOW_UNITS))


@query(f"SELECT u.file_id, CASE WHEN r.file_id IS NOT NULL THEN 'INCOMPLETE' WHEN block THEN 'BLOCK' WHEN n > 0 THEN 'WARN' ELSE 'PASS' END AS gate, CASE WHEN r.file_id IS NOT NULL THEN 0 ELSE coalesce(n, 0) END AS n FROM (SELECT DISTINCT file_id FROM ({NOW_UNITS}) w) u LEFT JOIN (SELECT file_id, bool_or(impact = 'block') AS block, count(*) AS n FROM ({FOUND}) f GROUP BY file_id) f ON f.file_id = u.file_id LEFT JOIN (SELECT DISTINCT file_id FROM {REPEATED} q) r ON r.file_id = u.file_id")
def readability_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.gates(relation(spark, sf_dir, NOW_UNITS), readability_candidates(spark, sf_dir))


NODES = "SELECT l_suppkey AS file_id, concat('p', CAST(l_partkey % 10 AS STRING)) AS parent, concat('n', CAST(l_linenumber AS STRING)) AS base, l_orderkey * 10 + l_linenumber AS ordinal FROM {lineitem}"


@query(f"SELECT file_id, ordinal, parent || '/' || base || CASE WHEN nth > 1 THEN '#' || CAST(nth AS VARCHAR) ELSE '' END AS symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, parent, base ORDER BY ordinal) AS nth FROM ({NODES}) n) x")
def structural_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.structural_ids(relation(spark, sf_dir, NODES)).select("file_id", "ordinal", "symbol_id")


MARKS = "SELECT l_suppkey AS file_id, l_orderkey % 50 AS symbol_id, CASE WHEN l_linenumber % 3 = 0 THEN 'decision' WHEN l_linenumber % 3 = 1 THEN 'outcome' ELSE 'other' END AS kind, CAST(l_partkey AS INT) AS line FROM {lineitem}"


@query(f"SELECT file_id, symbol_id, CAST(CASE WHEN d0 IS NULL OR o0 IS NULL THEN 0 ELSE greatest(abs(d1 - o0), abs(o1 - d0)) END AS INT) AS distance FROM (SELECT file_id, symbol_id, min(line) FILTER (kind = 'decision') AS d0, max(line) FILTER (kind = 'decision') AS d1, min(line) FILTER (kind = 'outcome') AS o0, max(line) FILTER (kind = 'outcome') AS o1 FROM ({MARKS}) m GROUP BY file_id, symbol_id) x")
def outcome_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.outcome_distance(relation(spark, sf_dir, MARKS))


# Documents.

TOLD = "SELECT doc_id, n, trim(regexp_replace(lower(line), '[[:space:]]+', ' ', 'g')) AS block FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM {documents}) y"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, arg_min(block, n) AS block, CAST(min(n) AS INT) AS ordinal FROM ({TOLD}) t WHERE doc_id % 10 <> 0 AND length(block) >= 120 AND block IN (SELECT block FROM ({TOLD}) u WHERE doc_id % 10 = 0) GROUP BY doc_id")
def copied_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that documents share with the first tenth of them, as blocks."""
    found = relation(spark, sf_dir, "SELECT CAST(doc_id AS STRING) AS path, doc_id, posexplode(split(text, chr(10), -1)) AS (ordinal, text) FROM {documents}")
    return documents.copied_blocks(found.where("doc_id % 10 != 0"), found.where("doc_id % 10 = 0"))


@query("""WITH p AS (SELECT url AS path, string_split(html, chr(10)) AS l, html FROM {pages}) SELECT path, CAST(o AS INT) AS ordinal, kind, CAST(level AS INT) AS level, text, target FROM (SELECT path, 0 AS o, 'heading' AS kind, 1 AS level, 'Page' AS text, CAST(NULL AS VARCHAR) AS target FROM p
UNION ALL SELECT path, 1, 'paragraph', NULL, 'see [a](' || path || ') there', NULL FROM p UNION ALL SELECT path, 2, 'link', NULL, 'a', path FROM p UNION ALL SELECT path, 3, 'code', NULL, 'x = [b](c)', NULL FROM p UNION ALL SELECT path, 4, 'paragraph', NULL, CAST(strlen(html) AS VARCHAR), NULL FROM p) x""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = "SELECT url AS path, concat('# Page #', chr(10), 'see', chr(10), '[a](', url, ') there', chr(10), '```', chr(10), 'x = [b](c)', chr(10), '```', chr(10), CAST(octet_length(encode(html, 'utf-8')) AS STRING)) AS content FROM {pages}"
    return documents.blocks(relation(spark, sf_dir, pages))


EDGES = "SELECT DISTINCT l_suppkey AS src, l_suppkey + CASE WHEN l_partkey % 41 = 0 THEN -(l_suppkey % 3) ELSE 1 + l_suppkey % 2 END AS dst FROM {lineitem} WHERE l_partkey % 7 = 0 OR l_partkey % 41 = 0"


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({EDGES}) x), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def reference_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.cycles(relation(spark, sf_dir, EDGES))


LEVELS = "SELECT user_id, CASE WHEN event_id % 60 = 0 THEN 'incomplete' ELSE 'policy' END AS level FROM {events}"


@query(f"SELECT user_id, CASE WHEN bool_or(level = 'incomplete') THEN 'INCOMPLETE' ELSE 'WARN' END AS gate FROM ({LEVELS}) l GROUP BY user_id")
def instruction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.instruction_gate(relation(spark, sf_dir, LEVELS), "user_id")


ROWS = "SELECT s_suppkey AS document, n, concat('| ', CAST(n AS STRING), ' | item | ', CASE WHEN (s_suppkey + n) % 20 = 0 THEN 'failed' WHEN (s_suppkey * n) % 6 = 1 THEN 'Partial' ELSE 'complete' END, ' |') AS text FROM {supplier} CROSS JOIN (VALUES " + ", ".join(f"({i})" for i in range(1, 20)) + ") AS t(n) WHERE NOT (s_suppkey % 9 = 0 AND n = 7)"


@query(f"""SELECT document, complete, partial, failed, contiguous, CAST(floor((complete * 2 + partial) * 500 / 19 + 0.5) AS BIGINT) AS accepted_tenths, complete >= 18 AND failed = 0 AND contiguous AS release
FROM (SELECT document, count(*) FILTER (text LIKE '%complete%') AS complete, count(*) FILTER (text LIKE '%Partial%') AS partial, count(*) FILTER (text LIKE '%failed%') AS failed, count(*) = 19 AS contiguous FROM ({ROWS}) r GROUP BY document) x""")
def acceptance_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.progress(relation(spark, sf_dir, ROWS))


# Hashes, ledger, cache.

@query(f"SELECT workspace, sha256(string_agg(CAST(strlen(path) AS VARCHAR) || ':' || path || '=' || sha256(content), chr(10) ORDER BY path)) AS hash FROM ({R.CONTENT}) c GROUP BY workspace")
def snapshot_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.snapshot_hash(files(spark, sf_dir), "workspace")


@query(f"SELECT user_id, sha256(string_agg(j, chr(10) ORDER BY j)) AS hash FROM (SELECT user_id, to_json({{{{'id': id, 'rule_id': rule_id, 'path': path, 'severity': severity, 'lifecycle': lifecycle}}}}) AS j FROM ({{findings}}) f) x GROUP BY user_id".replace("{{", "{").replace("}}", "}").replace("{findings}", R.FINDINGS))
def report_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.report_hash(relation(spark, sf_dir, R.FINDINGS), "user_id")


@query(f"SELECT sha256(string_agg(r, ';' ORDER BY r)) AS signature FROM (SELECT major_id || ':' || CAST(major_weight AS VARCHAR) || ':' || minor_id || ':' || CAST(weight AS VARCHAR) AS r FROM {R.MINORS} m) x")
def model_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.model_signature(scoring.minor_model(spark))


REQUESTS = "SELECT conv_id, turn, role, CAST(length(text) % 50 AS STRING) AS digest FROM {conversations}"
CACHE = "SELECT DISTINCT role, CAST(length(text) % 50 AS STRING) AS digest, CAST(length(text) % 50 * 400000 AS BIGINT) AS bytes, CAST(1000000000 - length(text) % 50 * 20000000 AS BIGINT) AS written_ms FROM {conversations} WHERE conv_id % 2 = 0"
FRAMED = "sha256(concat(CAST(strlen(role) AS VARCHAR), ':', role, CAST(strlen(digest) AS VARCHAR), ':', digest))"


@query(f"SELECT conv_id, turn, k AS cache_key FROM (SELECT *, {FRAMED} AS k FROM ({REQUESTS}) r) q WHERE k NOT IN (SELECT {FRAMED} FROM ({CACHE}) c WHERE bytes <= 8388608 AND 1000000000 - written_ms BETWEEN 0 AND 604800000)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger.usable(ledger.cache_key(relation(spark, sf_dir, CACHE), ["role", "digest"]), 1_000_000_000)
    return ledger.missing(ledger.cache_key(relation(spark, sf_dir, REQUESTS), ["role", "digest"]), entries).select("conv_id", "turn", "cache_key")
