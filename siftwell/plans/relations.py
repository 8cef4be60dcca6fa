"""Input relations bound to tables of a directory, as SQL text that Spark and DuckDB both run.

A text names tables in braces. ``relation`` runs it on Spark over the parquet files; ``oracle`` gives the text
for DuckDB, where the tables are views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

#: Standard score model: major, its weight and whether a specialist must assess it, then minors with weights, all in tenths of a point.
MODEL_TEXT = """
correctness 200 | intent-contract 40 | primary-path 40 | boundaries-invalid-input 40 | failure-timeout-retry-cancellation 40 | state-side-effects-idempotency 40
readability 200 | naming-intent-domain-language 30 | function-responsibility-size 40 | control-flow-visible-stages 40 | conditional-fallback-clarity 30 | try-catch-error-boundaries 30 | state-return-types-result-shapes 30
architecture 120 | cohesion-responsibility-ownership 30 | dependency-direction-layering 30 | public-interfaces-encapsulation 20 | shared-state-lifecycle-ownership 20 | abstraction-value-duplication 20
testing 120 | observable-behavior-coverage 30 | failure-boundary-coverage 30 | concurrency-timing-coverage 20 | determinism-isolation 20 | integration-contract-coverage 20
concurrency 120 | hot-path-amplification-capacity 20 | race-atomicity-toctou 20 | lock-scope-ownership-contention 20 | single-flight-idempotency-deduplication 20 | bounded-work-retries-queues-backpressure 20 | multi-instance-stampede-resource-bounds 20
security 120 | authentication-authorization-tenant-isolation 30 | input-injection-path-url-file-safety 30 | secrets-privacy-logging-retention-deletion 30 | trust-boundaries-exfiltration-least-privilege 30
compatibility 60 | api-event-schema-compatibility 20 | data-migration-multi-version-behavior 20 | configuration-release-rollback-deprecation 20
observability-docs-supply-chain 60 | errors-logs-metrics-traces-alerts 20 | documentation-repository-hygiene-operability 20 | dependencies-licenses-provenance-release-integrity 20
"""

MODEL = [(major, int(weight), [(m.split()[0], int(m.split()[1])) for m in minors]) for major, weight, minors in ((*line.split(" | ", 1)[0].rsplit(" ", 1), line.split(" | ")[1:]) for line in MODEL_TEXT.strip().splitlines())]
MINOR_ROWS = [(i, minor, weight, j, major, total) for i, (j, major, total, minor, weight) in enumerate((j, major, total, minor, weight) for j, (major, total, minors) in enumerate(MODEL) for minor, weight in minors)]


def values(rows: list[tuple], columns: str) -> str:
    """A relation of literals, for both engines."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({columns}))"


MINORS = values(MINOR_ROWS, "minor_no, minor_id, weight, major_no, major_id, major_weight")

_GRID = f"""
SELECT g.entity AS entity, m.minor_id AS minor_id,
       CASE WHEN (g.entity * 5 + m.minor_no * 3) % 23 = 4 THEN 'not_applicable' WHEN h.points IS NULL THEN 'not_assessed' ELSE 'scored' END AS status,
       CAST(CASE WHEN (g.entity * 5 + m.minor_no * 3) % 23 = 4 THEN NULL ELSE h.points % 11 END AS INT) AS half_points,
       CASE WHEN (g.entity * 5 + m.minor_no * 3) % 23 = 4 OR h.points IS NULL THEN NULL WHEN h.points % 7 = 0 THEN 'low' WHEN h.points % 3 = 0 THEN 'medium' ELSE 'high' END AS confidence
FROM (SELECT DISTINCT entity FROM hits) g CROSS JOIN {MINORS} m LEFT JOIN hits h ON h.entity = g.entity AND h.minor_no = m.minor_no
"""

#: (entity, minor_id, status, half_points, confidence): one row for each minor; ratings in half points, 0 to 10.
ASSESSMENTS = "WITH hits AS (SELECT o_custkey AS entity, l_partkey % 37 AS minor_no, sum(l_linenumber) AS points FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey % 37)" + _GRID
SUPPLIER_ASSESSMENTS = "WITH hits AS (SELECT l_suppkey AS entity, l_partkey % 37 AS minor_no, sum(l_linenumber) AS points FROM {lineitem} GROUP BY l_suppkey, l_partkey % 37)" + _GRID
BASELINE_ASSESSMENTS = "WITH hits AS (SELECT l_suppkey AS entity, l_partkey % 37 AS minor_no, sum(l_linenumber) AS points FROM {lineitem} WHERE l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY l_suppkey, l_partkey % 37)" + _GRID

#: One row for each finding; a single stage; titles with a ligature, evidence with letters and signs beyond ASCII.
FINDINGS = """
SELECT concat('f-', CAST(event_id AS STRING)) AS id, event_type AS rule_id,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('src/m', CAST(user_id % 50 AS STRING), CASE WHEN user_id % 3 = 0 THEN '.tsx' ELSE '.ts' END) END AS path,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 + 1 END AS start_line,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 + 1 + CAST(user_id % 2 AS INT) END AS end_line,
       concat(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END, CASE WHEN event_id % 4 = 0 THEN ' proﬁle' ELSE ' profile' END, ' lacks retry boundary', CASE WHEN user_id % 5 = 0 THEN ' token' ELSE '' END) AS title,
       CASE WHEN value < 20 THEN 'P0' WHEN value < 60 THEN 'P1' WHEN value < 120 THEN 'P2' WHEN value < 200 THEN 'P3' ELSE 'NIT' END AS severity,
       CASE event_id % 7 WHEN 0 THEN 'candidate' WHEN 1 THEN 'corroborated' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'reported' WHEN 4 THEN 'uncertain' WHEN 5 THEN 'dismissed' ELSE 'waived' END AS lifecycle,
       CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
       CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'preexisting' ELSE 'unknown' END AS disposition,
       CASE user_id % 8 WHEN 0 THEN 'security' WHEN 1 THEN 'concurrency' WHEN 2 THEN 'testing' WHEN 3 THEN 'readability' WHEN 4 THEN 'data' WHEN 5 THEN 'behavior' WHEN 6 THEN 'universal' ELSE 'ui' END AS stage,
       concat('evidence ', CAST(event_id % 13 AS STRING), CASE WHEN event_id % 5 = 0 THEN ' with more lock detail' ELSE '' END, CASE event_id % 8 WHEN 3 THEN ' 😀' WHEN 4 THEN ' ééé' WHEN 5 THEN ' éé' ELSE '' END) AS evidence,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('checked ', CAST(event_id % 9 AS STRING)) END AS verification,
       event_id % 4 = 1 AS unresolved, user_id AS user_id, event_id AS event_id
FROM {events}
"""

#: (id, expected, high, reported, repeats) of labelled cases; lists are comma-separated, repeats separated by bars.
CASES = """
SELECT concat('case-', CAST(l.doc_id AS STRING)) AS id,
       concat(CASE WHEN quality = 0 THEN 'bad-quality,' ELSE '' END, CASE WHEN toxic = 1 THEN 'toxic,' ELSE '' END) AS expected,
       CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS high,
       CASE WHEN l.doc_id % 10 = 9 THEN NULL ELSE concat(CASE WHEN quality = 0 AND l.doc_id % 4 > 0 THEN 'bad-quality,' ELSE '' END, CASE WHEN toxic = 1 AND l.doc_id % 5 > 0 THEN 'toxic,' ELSE '' END, CASE WHEN d.n_chars > 6000 THEN 'long,' ELSE '' END, CASE WHEN l.doc_id % 7 = 0 AND toxic = 1 AND l.doc_id % 5 > 0 THEN 'toxic,' ELSE '' END) END AS reported,
       CASE WHEN l.doc_id % 3 = 0 THEN concat(CASE WHEN toxic = 1 AND l.doc_id % 5 > 0 THEN 'toxic,' ELSE '' END, CASE WHEN quality = 0 AND l.doc_id % 4 > 0 THEN 'bad-quality,' ELSE '' END, CASE WHEN d.n_chars > 6000 THEN 'long,' ELSE '' END, '|', CASE WHEN l.doc_id % 2 = 0 THEN 'toxic,' ELSE '' END) ELSE NULL END AS repeats,
       d.n_chars AS latency_ms, CASE WHEN l.doc_id % 8 = 0 THEN -1 ELSE d.n_chars % 100 END AS input_tokens
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""

#: (workspace, ordinal, path, status, is_binary, content): files in order; contents are documents.
CONTENT = """
SELECT lang AS workspace, doc_id AS ordinal, concat(CASE doc_id % 19 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'app/dist/' WHEN 2 THEN '.git/' WHEN 3 THEN 'x/__pycache__/' WHEN 4 THEN 'conf/.env.' WHEN 5 THEN 'a//' WHEN 6 THEN '../' ELSE concat(source, '/') END, CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.PNG' WHEN 2 THEN '.tsx' ELSE '.md' END) AS path,
       CASE WHEN doc_id % 23 = 5 THEN 'deleted' WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'renamed' ELSE 'modified' END AS status, doc_id % 29 = 7 AS is_binary, text AS content
FROM {documents}
"""


def relation(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


def oracle(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)
