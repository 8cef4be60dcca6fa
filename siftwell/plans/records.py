"""Registered queries over captures, forges, stage answers, input and output documents, and instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import content, inputs, instructions, ledger, policy, reports, scoring, selection, stage_output
from ..sources import captures, files, forges
from . import catalog
from . import relations as R
from .registry import query
from .relations import relation

# Captures: records are made from the rows that parsing must give back.

CHANGED = """SELECT p_partkey AS k, p_partkey % 60 AS capture_id, concat('src/d', CAST(p_size AS STRING), '/fé ', CAST(p_partkey AS STRING), '.ts') AS path,
CASE WHEN p_partkey % 7 IN (1, 4) THEN concat('old/', CAST(p_partkey AS STRING)) END AS previous_path,
CASE p_partkey % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'copied' WHEN 2 THEN 'deleted' WHEN 3 THEN 'modified' WHEN 4 THEN 'renamed' WHEN 5 THEN 'type_changed' ELSE 'unmerged' END AS status,
p_partkey % 11 = 0 AS is_binary, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 3 END AS additions, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 90 END AS deletions FROM {part}"""


def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, raw, numstat) of the changed files; every twentieth capture lacks its last NUL."""
    f = relation(spark, sf_dir, CHANGED)
    letter = F.element_at(F.create_map(*(F.lit(x) for k, v in captures.STATUSES.items() for x in (v, k))), F.col("status"))
    moved, nul = F.col("previous_path").isNotNull(), "\0"
    raw = F.concat(F.lit(":100644 100755 "), F.repeat(F.lit("a"), F.lit(40)), F.lit(" "), F.repeat(F.lit("b"), F.lit(40)), F.lit(" "), letter, F.when(moved, "090").otherwise(""), F.lit(nul), F.when(moved, F.concat("previous_path", F.lit(nul))).otherwise(""), F.col("path"), F.lit(nul))
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    stat = F.concat(n("additions"), F.lit("\t"), n("deletions"), F.lit("\t"), F.when(moved, F.concat(F.lit(nul), "previous_path", F.lit(nul))).otherwise(""), F.col("path"), F.lit(nul))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("r")))), lambda x: x["r"]), "")
    whole = f.groupBy("capture_id").agg(join(raw).alias("raw"), join(stat).alias("numstat"))
    return whole.withColumn("raw", F.when(F.col("capture_id") % 20 == 7, F.left("raw", F.length("raw") - 1)).otherwise(F.col("raw")))


PARSED = "capture_id, path, previous_path, status, is_binary, CAST(additions AS BIGINT) AS additions, CAST(deletions AS BIGINT) AS deletions"
SNAPSHOT_SQL = f"SELECT {PARSED}, NULL AS issue FROM ({CHANGED}) c WHERE capture_id % 20 <> 7 UNION ALL SELECT DISTINCT capture_id, NULL, NULL, NULL, CAST(NULL AS BOOLEAN), NULL, NULL, 'not_terminated' FROM ({CHANGED}) d WHERE capture_id % 20 = 7"
SHOWN = ["capture_id", "path", "previous_path", "status", "is_binary", "additions", "deletions", "issue"]


@query(SNAPSHOT_SQL)
def git_snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.snapshot_files(capture_records(spark, sf_dir)).select(SHOWN)


@query(SNAPSHOT_SQL.replace("= 7", "= 6").replace("'not_terminated'", "'no_boundary'").replace("<> 7", "<> 6"))
def git_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture_records(spark, sf_dir).withColumn("raw", F.when(F.col("capture_id") % 20 == 7, F.concat("raw", F.lit("\0"))).otherwise(F.col("raw")))
    output = F.concat("raw", "numstat", F.when(F.col("capture_id") % 20 == 6, "").otherwise("\0diff --git a/x b/x\n"))
    parts = captures.envelopes(rows.select("capture_id", output.alias("output")))
    broken = parts.where("issue is not null").select("capture_id", *(F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("previous_path", "string"), ("status", "string"), ("is_binary", "boolean"), ("additions", "bigint"), ("deletions", "bigint"))), "issue")
    return captures.snapshot_files(parts.where("issue is null")).select(SHOWN).unionByName(broken)


LIMITED = f"SELECT capture_id, path, previous_path, CAST(additions AS BIGINT) AS additions, CAST(deletions AS BIGINT) * CASE WHEN capture_id % 15 = 4 AND k % 5 = 0 THEN -1 ELSE 1 END AS deletions, CASE WHEN capture_id % 15 = 8 THEN '10064' ELSE '100644' END AS old_mode, CAST(NULL AS STRING) AS new_mode, CASE WHEN capture_id % 15 = 9 THEN 'xyz' END AS old_object, CAST(NULL AS STRING) AS new_object FROM ({CHANGED}) c"
LEFT_OUT = f"SELECT capture_id, CASE WHEN capture_id % 15 = 11 THEN '../x' ELSE path END AS path, CASE WHEN capture_id % 15 = 12 THEN '' ELSE 'generated' END AS reason FROM ({CHANGED}) c WHERE k % 3 = 0"


@query(f"""WITH f AS (SELECT capture_id, count(*) AS n, sum(coalesce(additions, 0) + coalesce(deletions, 0)) AS lines, bool_or(deletions < 0) AS neg, bool_or(old_mode = '10064') AS mode, bool_or(old_object = 'xyz') AS obj FROM ({LIMITED}) a GROUP BY capture_id),
e AS (SELECT capture_id, count(*) AS n, bool_or(path = '../x' OR reason = '') AS bad FROM ({LEFT_OUT}) b GROUP BY capture_id)
SELECT f.capture_id, f.n AS n_files, coalesce(e.n, 0) AS n_exclusions, CAST(f.lines AS BIGINT) AS changed_lines, CASE WHEN f.n > 200 OR coalesce(e.n, 0) > 400 OR f.lines > 10000 THEN 'limit' WHEN neg THEN 'line_count' WHEN mode THEN 'mode' WHEN obj THEN 'object_id' WHEN coalesce(bad, false) THEN 'exclusion' END AS issue FROM f LEFT JOIN e ON f.capture_id = e.capture_id""")
def snapshot_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.snapshot_limits(relation(spark, sf_dir, LIMITED), relation(spark, sf_dir, LEFT_OUT), "capture_id")


@query(f"SELECT capture_id, path, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY path, coalesce(previous_path, '')) AS INT) AS ordinal FROM ({CHANGED}) c")
def snapshot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.ordered_files(relation(spark, sf_dir, CHANGED), "capture_id").select("capture_id", "path", "ordinal")


@query("SELECT doc_id, sha256(strlen(lang) || ':' || lang || CASE WHEN doc_id % 5 = 0 OR text IS NULL THEN '-1:' ELSE strlen(text) || ':' || text END) AS hash FROM {documents}")
def parts_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "SELECT doc_id, lang, CASE WHEN doc_id % 5 <> 0 THEN text END AS text FROM {documents}").select("doc_id", captures.parts_hash(F.col("lang"), F.col("text")).alias("hash"))


@query("SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM {documents} WHERE text IS NOT NULL GROUP BY lang")
def selected_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "SELECT lang, text FROM {documents} WHERE text IS NOT NULL").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))


# Forges.

URLS = """SELECT o_orderkey AS id, concat(CASE o_orderkey % 23 WHEN 3 THEN 'http' ELSE 'https' END, '://', CASE o_orderkey % 23 WHEN 5 THEN 'me@' ELSE '' END, CASE WHEN o_orderkey % 23 = 7 THEN 'example.org' WHEN o_orderkey % 2 = 0 THEN 'github.com' ELSE 'GitLab.com' END, CASE o_orderkey % 23 WHEN 9 THEN ':8443' ELSE '' END,
CASE WHEN o_orderkey % 2 = 0 THEN concat('/org%20x/app-', CAST(o_custkey AS STRING), CASE o_orderkey % 23 WHEN 11 THEN '/issues/' ELSE '/pull/' END) ELSE concat('/group/sub/app-', CAST(o_custkey AS STRING), '/-/merge_requests/') END,
CASE o_orderkey % 23 WHEN 13 THEN '0' WHEN 15 THEN 'abc' ELSE CAST(o_orderkey AS STRING) END, CASE o_orderkey % 23 WHEN 17 THEN '#note' WHEN 19 THEN '?tab=1' ELSE '' END) AS url FROM {orders}"""
URL_ISSUE = "CASE o_orderkey % 23 WHEN 3 THEN 'not_https' WHEN 5 THEN 'userinfo' WHEN 9 THEN 'port' WHEN 17 THEN 'fragment' WHEN 7 THEN 'untrusted_host' WHEN 11 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'shape' END WHEN 13 THEN 'number' WHEN 15 THEN 'number' ELSE CASE WHEN o_orderkey = 0 THEN 'number' END END"


@query(f"""SELECT id, CASE WHEN issue IS NULL THEN kind END AS kind, CASE WHEN issue IS NULL THEN owner END AS owner, CASE WHEN issue IS NULL THEN repository END AS repository, CASE WHEN issue IS NULL THEN id END AS number,
CASE WHEN issue IS NULL THEN 'https://' || kind || '.com/' || owner || '/' || repository || CASE WHEN kind = 'github' THEN '/pull/' ELSE '/-/merge_requests/' END || id END AS canonical, issue
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'github' ELSE 'gitlab' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'org x' ELSE 'group/sub' END AS owner, 'app-' || o_custkey AS repository, {URL_ISSUE} AS issue FROM {{orders}}) o""")
def forge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forges.address(relation(spark, sf_dir, URLS)).drop("url")


ENTRIES = "SELECT l_orderkey AS change_id, l_linenumber AS n, l_partkey AS part, l_partkey % 5 AS kind FROM {lineitem}"


def change_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(change_id, body): the lines of an order as a list of changes in JSON."""
    e = relation(spark, sf_dir, ENTRIES)
    is_ = lambda k: F.when(F.col("kind") == k, True)
    entry = F.struct(F.when(F.col("kind") != 4, F.concat(F.lit("new/"), F.col("part").cast("string"))).alias("new_path"), F.concat(F.lit("old/"), F.col("part").cast("string")).alias("old_path"), is_(0).alias("new_file"), is_(1).alias("deleted_file"), is_(2).alias("renamed_file"), F.when(F.col("part") % 3 > 0, F.lit("@@ -1 +1 @@")).alias("diff"))
    return e.groupBy("change_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n", "part", entry.alias("e")))), lambda x: x["e"]).alias("changes"))).alias("body"))


@query(f"""SELECT change_id, false AS incomplete, CAST(row_number() OVER (PARTITION BY change_id ORDER BY n, part) - 1 AS INT) AS ordinal, CASE WHEN kind <> 4 THEN 'new/' ELSE 'old/' END || part AS path, CASE WHEN kind = 2 THEN 'old/' || part END AS previous_path,
CASE kind WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status, part % 3 = 0 AS is_binary FROM ({ENTRIES}) e""")
def forge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forges.merge_request_files(change_lists(spark, sf_dir))


# Answers of stages, with one fault each.

BAD = {
    0: ("", None, None), 1: (",\"extra\":1", "/candidates/0", "additionalProperties"), 2: (",\"startLine\":0", "/candidates/0/startLine", "minimum"), 3: (",\"endLine\":1.5", "/candidates/0/endLine", "type"), 4: (",\"severity\":\"P9\"", "/candidates/0/severity", "enum"),
    5: (",\"evidence\":\"short\"", "/candidates/0/evidence", "minLength"), 6: (",\"impact\":\"\"", "/candidates/0/impact", "minLength"), 7: (",\"path\":null", "/candidates/0/path", "type"), 8: (",\"sourceQuote\":\"tiny\"", "/candidates/0/sourceQuote", "minLength"),
}


def case(k: int) -> str:
    """Part k of the fault that an order's customer chooses, as the beginning of a CASE."""
    return "CASE o_custkey % 11 " + " ".join(f"WHEN {i} THEN '{v[k]}'" for i, v in BAD.items() if v[k] is not None)


ANSWERS = f"""SELECT o_orderkey AS stage_id, CASE o_custkey % 11 WHEN 9 THEN '[]' WHEN 10 THEN '{{{{"candidates":[],"assessments":[{{{{"minorId":"m","status":"scored","rating":2.3,"confidence":"low","evidence":[{{{{"path":"a","startLine":1,"endLine":1,"sourceQuote":"12345678"}}}}],"explanation":"e"}}}}]}}}}'
ELSE concat('{{{{"candidates":[{{{{"title":"T', CAST(o_custkey AS STRING), '","severity":"P1","evidence":"long enough evidence","path":"src/a.ts","startLine":', CAST(o_orderkey % 9 + 1 AS STRING), ',"endLine":9,"sourceQuote":"quoted text"', {case(0)} END, '}}}}],"assessments":[{{{{"minorId":"m', CAST(o_custkey AS STRING), '","status":"not_applicable","reason":"none here"}}}}]}}}}') END AS content FROM {{orders}}""".replace("{{", "{").replace("}}", "}").replace("{{", "{").replace("}}", "}")
FAULT_SQL = f"SELECT o_orderkey AS stage_id, o_custkey % 11 = 0 AS ok, {case(1)} WHEN 9 THEN '/' WHEN 10 THEN '/assessments/0/rating' END AS path, {case(2)} WHEN 9 THEN 'type' WHEN 10 THEN 'multipleOf' END AS keyword FROM {{orders}}"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, ANSWERS)


@query(FAULT_SQL)
def stage_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_output.validated(answers(spark, sf_dir))


@query("SELECT o_orderkey AS stage_id, 0 AS ordinal, 'T' || o_custkey AS title, 'P1' AS severity, 'src/a.ts' AS path, CAST(o_orderkey % 9 + 1 AS INT) AS start_line, 9 AS end_line, 'quoted text' AS quote FROM {orders} WHERE o_custkey % 11 = 0")
def stage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    good = rows.join(stage_output.validated(rows).where("ok").select("stage_id"), "stage_id", "left_semi")
    return stage_output.candidates(good).select("stage_id", "ordinal", "title", "severity", "path", "start_line", "end_line", "quote")


@query("SELECT o_orderkey AS stage_id, 0 AS ordinal, 'm' || o_custkey AS minor_id, 'not_applicable' AS status, CAST(NULL AS INT) AS half_points, 'none here' AS text FROM {orders} WHERE o_custkey % 11 = 0")
def stage_answer_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    good = rows.join(stage_output.validated(rows).where("ok").select("stage_id"), "stage_id", "left_semi")
    return stage_output.assessments(good).select("stage_id", "ordinal", "minor_id", "status", "half_points", "text")


# Documents that leave.

EXPORTED = f"SELECT *, CASE WHEN event_id % 9 = 0 THEN concat('RV-ABC-', lpad(CAST(event_id % 1000 AS STRING), 3, '0')) ELSE rule_id END AS own_rule, CASE WHEN event_id % 4 = 0 THEN ' ab ' WHEN event_id % 4 = 1 THEN 'a real impact ' END AS impact FROM ({R.FINDINGS}) f"
STAND_IN = "CASE stage " + " ".join(f"WHEN '{s}' THEN 'RV-{a}-{n:03d}'" for s, (a, n) in reports.SUBJECTS.items()) + " ELSE 'RV-REV-001' END"


@query(f"""SELECT id, CASE WHEN event_id % 9 = 0 THEN own_rule ELSE {STAND_IN} END AS rule_id, lifecycle AS status, coalesce(path, 'unknown') AS path, coalesce(start_line, 1) AS start_line, coalesce(end_line, start_line, 1) AS end_line, 'stage:' || stage AS trigger, evidence AS actual_behavior,
CASE WHEN event_id % 4 = 1 THEN 'a real impact' ELSE 'Impact requires assessment' END AS impact, coalesce(verification, 'Verify against snapshot and context evidence') AS verification, CASE WHEN lifecycle IN ('confirmed', 'reported') THEN '2026-01-01T00:00:00Z' END AS verified_at FROM ({EXPORTED}) x""")
def finding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, EXPORTED).withColumn("rule_id", F.col("own_rule")).withColumn("stages", F.array("stage"))
    out = reports.finding_documents(rows, "RV", "2026-01-01T00:00:00Z")
    return out.select("id", "rule_id", "status", "path", "start_line", "end_line", "trigger", "actual_behavior", "impact", "verification", "verified_at")


BUCKETS = f"SELECT user_id % 50 AS run_id, id, title, evidence, path, severity, event_id AS ordinal, CASE WHEN lifecycle IN ('confirmed', 'reported') THEN 'findings' WHEN lifecycle IN ('waived', 'dismissed', 'corroborated') THEN lifecycle ELSE 'uncertain' END AS bucket FROM ({R.FINDINGS}) f"
RUNS = "SELECT s_suppkey AS run_id, CASE WHEN s_suppkey % 3 = 0 THEN 'BLOCK' ELSE 'PASS' END AS gate, CAST(s_suppkey % 100 AS DOUBLE) + 0.25 AS normalized, CASE WHEN s_suppkey % 4 > 0 THEN 86.04 END AS coverage, s_suppkey % 2 = 0 AS incomplete, 'abc' AS report_hash FROM {supplier} WHERE s_suppkey <= 60"
PLACE = "CASE bucket WHEN 'findings' THEN 1 WHEN 'corroborated' THEN 2 WHEN 'uncertain' THEN 3 WHEN 'waived' THEN 4 END"


@query(f"""SELECT r.run_id, any_value(gate) AS gate, coalesce(list(b.id ORDER BY {PLACE}, b.ordinal) FILTER (b.id IS NOT NULL), []) AS finding_ids, CAST(floor(any_value(normalized) * 10 + 0.5) AS BIGINT) AS normalized_tenths, CAST(floor(any_value(coverage) * 10 + 0.5) AS BIGINT) AS coverage_tenths
FROM ({RUNS}) r LEFT JOIN (SELECT * FROM ({BUCKETS}) x WHERE bucket <> 'dismissed') b ON b.run_id = r.run_id GROUP BY r.run_id""")
def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_documents(relation(spark, sf_dir, RUNS), relation(spark, sf_dir, BUCKETS))


INLINE = "replace(regexp_replace({c}, '([#()._-])', '\\\\\\1', 'g'), '  ', '  ')"
LINE = f"'- **' || severity || '** ' || {INLINE.replace('{c}', 'title')} || ' (' || {INLINE.replace('{c}', 'id')} || ')'"
WHOLE = f"'### ' || severity || ': ' || {INLINE.replace('{c}', 'title')} || chr(10) || chr(10) || '- ID: ' || {INLINE.replace('{c}', 'id')} || chr(10) || '- Evidence: ' || {INLINE.replace('{c}', 'evidence')} || chr(10) || '- Impact: breaks' || chr(10) || '- Remediation: mend' || chr(10)"
PART = lambda b, line: f"(SELECT string_agg({line}, chr(10) ORDER BY b.ordinal) FROM ({BUCKETS}) b WHERE b.run_id = r.run_id AND b.bucket = '{b}')"


@query(f"""SELECT run_id, '# Review' || chr(10) || chr(10) || '- Gate: **' || gate || '**' || chr(10) || '- Run: `' || run_id || '`' || chr(10) || '- Report hash: `abc`' || chr(10) || '- Incomplete: ' || CASE WHEN incomplete THEN 'yes' ELSE 'no' END || chr(10) || chr(10) || '## Findings' || chr(10)
|| chr(10) || coalesce({PART('findings', WHOLE)}, '_No confirmed findings._' || chr(10)) {''.join(f"|| chr(10) || '## {b.capitalize()}' || chr(10) || chr(10) || coalesce({PART(b, LINE)}, '_None._') || chr(10) " for b in ('corroborated', 'uncertain', 'waived'))} || chr(10) AS report FROM ({RUNS}) r""")
def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, BUCKETS).withColumns({"impact": F.lit("breaks"), "remediation": F.lit("mend")})
    return reports.markdown_report(relation(spark, sf_dir, RUNS), rows)


PLAIN = "'- [' || severity || '] ' || title || ' (' || id || ')'"


@query(f"""SELECT run_id, 'Gate: ' || gate || chr(10) || 'Run: ' || run_id || chr(10) || 'Report: abc' || chr(10) || 'Incomplete: ' || CASE WHEN incomplete THEN 'yes' ELSE 'no' END || chr(10) || chr(10) || 'Findings:' || chr(10) || coalesce({PART('findings', PLAIN + " || chr(10) || '  evidence: ' || evidence || CASE WHEN path IS NOT NULL THEN chr(10) || '  path: ' || path ELSE '' END")}, '- none')
{''.join(f"|| chr(10) || chr(10) || '{b.capitalize()}:' || chr(10) || coalesce({PART(b, PLAIN)}, '- none') " for b in ('corroborated', 'uncertain', 'waived'))} || chr(10) || chr(10) || 'Residual risk:' || chr(10) || CASE WHEN incomplete THEN '- Review incomplete; do not treat Gate PASS as full assurance.' ELSE '- No structural incompleteness recorded by orchestrator.' END || chr(10) || chr(10) AS report FROM ({RUNS}) r""")
def terminal_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.terminal_report(relation(spark, sf_dir, RUNS), relation(spark, sf_dir, BUCKETS).withColumn("verification", F.lit(None).cast("string")))


MEASURED = "SELECT doc_id, n_chars % 7 AS decision_count, n_chars % 5 AS return_count FROM {documents}"


@query("SELECT doc_id, n_chars % 7 AS decisions, n_chars % 5 AS returns FROM {documents}")
def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.metric_record(relation(spark, sf_dir, MEASURED)).select("doc_id", F.col("record.decision_count").alias("decisions"), F.col("record.return_count").alias("returns"))


COUNTS = "SELECT o_orderkey AS id, o_custkey % 200 AS n_candidates, o_orderkey % 160 AS n_diagnostics, CASE WHEN o_orderkey % 2 = 0 THEN 'PASS' ELSE 'WARN' END AS gate FROM {orders}"


@query(f"SELECT id, least(n_candidates, 128) AS candidates, CASE WHEN n_candidates > 128 OR n_diagnostics > 128 THEN least(n_diagnostics, 127) + 1 ELSE n_diagnostics END AS diagnostics, CASE WHEN n_candidates > 128 OR n_diagnostics > 128 THEN 'INCOMPLETE' ELSE gate END AS gate FROM ({COUNTS}) c")
def bounded_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bounded_report(relation(spark, sf_dir, COUNTS), "id")


@query("SELECT doc_id, turn, offset_, rule_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY offset_, rule_id) AS INT) AS ordinal FROM (SELECT conv_id AS doc_id, turn, (turn * 7) % 5 AS offset_, 'R-' || turn AS rule_id FROM {conversations}) c")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "SELECT conv_id AS doc_id, turn, (turn * 7) % 5 AS start_offset, concat('R-', CAST(turn AS STRING)) AS rule_id FROM {conversations}")
    return reports.ordered_candidates(rows, "doc_id").withColumnRenamed("start_offset", "offset_")


# Documents that come in.

INPUTS = """SELECT s_suppkey AS path, concat('{{"assessments":[{{"minorId":"primary-path","status":"scored","rating":', CAST((s_suppkey % 11) / 2.0 AS STRING), ',"confidence":"high"}}],"context":{{"scope":"', CASE s_suppkey % 9 WHEN 1 THEN 'focused_domain' WHEN 2 THEN 'planet' ELSE 'change' END, '","gate":"WARN"',
CASE s_suppkey % 9 WHEN 1 THEN ',"focusedDomainId":"security"' WHEN 3 THEN ',"focusedDomainId":"security"' WHEN 4 THEN ',"blockingFindings":[{{"id":"f","confirmed":true,"blocking":true}}]' WHEN 5 THEN ',"blockingFindings":[{{"id":" ","confirmed":true,"blocking":true}}]' WHEN 6 THEN ',"more":1' ELSE '' END, '}}', CASE s_suppkey % 9 WHEN 7 THEN ',"schemaVersion":1' WHEN 8 THEN ',"baseline":null' ELSE '' END, '}}') AS content FROM {{supplier}}""".replace("{{", "{").replace("}}", "}")
INPUT_ISSUE = "CASE s_suppkey % 9 WHEN 2 THEN 'context' WHEN 3 THEN 'context' WHEN 5 THEN 'blocking' WHEN 6 THEN 'keys' WHEN 7 THEN 'schemaVersion' WHEN 8 THEN 'keys' END"


@query(f"""SELECT path, issue, CASE WHEN issue IS NULL THEN scope END AS scope, CASE WHEN issue IS NULL THEN 'WARN' END AS gate, CASE WHEN issue IS NULL AND scope = 'focused_domain' THEN 'security' END AS domain, CASE WHEN issue IS NULL THEN b END AS blocking
FROM (SELECT s_suppkey AS path, {INPUT_ISSUE} AS issue, CASE WHEN s_suppkey % 9 = 1 THEN 'focused_domain' ELSE 'change' END AS scope, s_suppkey % 9 = 4 AS b FROM {{supplier}}) s""")
def score_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.score_inputs(relation(spark, sf_dir, INPUTS)).select("path", "issue", "scope", "gate", "domain", "blocking")


@query(f"SELECT s_suppkey AS entity, 'primary-path' AS minor_id, 'scored' AS status, CAST(s_suppkey % 11 AS INT) AS half_points, 'high' AS confidence FROM {{supplier}} WHERE ({INPUT_ISSUE}) IS NULL")
def score_input_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.assessments_of(inputs.score_inputs(relation(spark, sf_dir, INPUTS)))


SETTINGS = """SELECT c_custkey AS path, concat('{{"schemaVersion":"1","defaultProvider":"', CASE c_custkey % 7 WHEN 1 THEN 'nobody' ELSE 'p0' END, '","providers":[{{"name":"', CASE c_custkey % 7 WHEN 2 THEN 'p 0' ELSE 'p0' END, '","kind":"', CASE c_custkey % 7 WHEN 3 THEN 'local' ELSE 'service' END,
'","endpoint":"https://x","credentialEnv":"', CASE c_custkey % 7 WHEN 4 THEN 'key' ELSE 'KEY' END, '","allowedModels":["a","b"],"defaultModel":"', CASE c_custkey % 7 WHEN 5 THEN 'c' ELSE 'a' END, '"}},{{"name":"', CASE c_custkey % 7 WHEN 6 THEN 'p0' ELSE 'p1' END, '","kind":"command","executable":"/bin/x","allowedModels":["m"],"defaultModel":"m"}}]}}') AS content FROM {{customer}}""".replace("{{", "{").replace("}}", "}")
SETTING_ISSUE = "CASE c_custkey % 7 WHEN 1 THEN 'default_provider' WHEN 2 THEN 'name' WHEN 3 THEN 'kind' WHEN 4 THEN 'credential' WHEN 5 THEN 'default_model' WHEN 6 THEN 'duplicate_name' END"


@query(f"""SELECT c_custkey AS path, {SETTING_ISSUE} AS issue, NULL AS provider, NULL AS kind, CAST(NULL AS BOOLEAN) AS is_default FROM {{customer}} WHERE c_custkey % 7 > 0 UNION ALL SELECT c_custkey, NULL, p, CASE p WHEN 'p0' THEN 'service' ELSE 'command' END, p = 'p0' FROM {{customer}}, (VALUES ('p0'), ('p1')) v(p) WHERE c_custkey % 7 = 0""")
def user_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.user_configs(relation(spark, sf_dir, SETTINGS), commands=("command",), services=("service",)).select("path", "issue", "provider", "kind", "is_default")


# Column functions and small operators, each over a whole table.

REPOSITORY = "SELECT lang AS workspace, doc_id AS ordinal, n_chars AS size FROM {documents}"


@query("""WITH RECURSIVE f AS (SELECT lang AS workspace, doc_id AS ordinal, n_chars AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM {documents}),
w AS (SELECT DISTINCT workspace, CAST(NULL AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS outcome FROM f UNION ALL SELECT f.workspace, f.ordinal, f.nth, w.used + CASE WHEN f.nth <= 20 AND size <= 6000 AND w.used + size <= 20000 THEN size ELSE 0 END,
CASE WHEN f.nth > 60 THEN 'overflow' WHEN f.nth > 20 OR size > 6000 THEN 'file_limit' WHEN w.used + size > 20000 THEN 'aggregate_byte_limit' ELSE 'content' END FROM f JOIN w ON w.workspace = f.workspace AND f.nth = w.nth + 1) SELECT workspace, ordinal, outcome FROM w WHERE nth > 0""")
def repository_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.repository_review(relation(spark, sf_dir, REPOSITORY), "workspace", 60, 20, 6000, 20_000)


SEEN = "SELECT p_size AS review, p_partkey AS ordinal, p_name || CAST(p_partkey % 3 AS STRING) AS path, CASE WHEN p_partkey % 5 = 0 THEN 'deleted' ELSE 'modified' END AS status, p_partkey % 7 = 0 AS is_binary FROM {part}"
OUT_OF = "SELECT p_size AS review, p_partkey AS ordinal, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name || CAST(p_partkey % 3 AS STRING) END AS path, concat('why ', CAST(p_partkey % 6 AS STRING)) AS reason FROM {part} WHERE p_partkey % 2 = 0"


@query(f"""WITH a AS (SELECT review, path, min(ordinal) AS place FROM ({SEEN}) s WHERE status <> 'deleted' AND NOT is_binary GROUP BY review, path), e AS (SELECT *, row_number() OVER (PARTITION BY review, path ORDER BY ordinal) AS nth FROM ({OUT_OF}) o),
n AS (SELECT a.review, 0 AS rest, place, a.path, coalesce(reason, 'unsupported') AS reason, e.ordinal AS used FROM a LEFT JOIN e ON a.review = e.review AND a.path = e.path AND nth = 1),
u AS (SELECT review, rest, place, path, reason FROM n UNION ALL SELECT review, 1, ordinal, path, reason FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.review = e.review AND n.used = e.ordinal)), r AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY rest, place, path) AS ordinal FROM u)
SELECT review, CAST(ordinal AS INT) AS ordinal, path, reason FROM r WHERE ordinal <= 30 OR rest = 0""")
def metadata_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.metadata_exclusions(relation(spark, sf_dir, SEEN), relation(spark, sf_dir, OUT_OF), "review", 30)


TRIED = "SELECT o_custkey AS run, o_orderkey AS ordinal, o_orderkey % 3 AS consumed FROM {orders}"


@query(f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ordinal) AS nth FROM ({TRIED}) t), w AS (SELECT DISTINCT run, CAST(NULL AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS nth, CAST(7 AS BIGINT) AS available, CAST(NULL AS INT) AS reserved FROM f
UNION ALL SELECT f.run, f.ordinal, f.nth, CASE WHEN w.available < 1 THEN w.available ELSE w.available - least(2, w.available, consumed) END, CASE WHEN w.available >= 1 THEN CAST(least(2, w.available) AS INT) END FROM f JOIN w ON w.run = f.run AND f.nth = w.nth + 1) SELECT run, ordinal, reserved FROM w WHERE nth > 0""")
def stage_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.attempts(relation(spark, sf_dir, TRIED), "run", 7)


ORIGINS = "SELECT DISTINCT p_size AS profile, p_brand AS source, p_partkey % 4 AS precedence FROM {part}"


@query(f"SELECT profile, source, precedence, CAST(row_number() OVER (PARTITION BY profile ORDER BY precedence, source) AS INT) AS ordinal FROM ({ORIGINS}) o")
def policy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ordered_sources(relation(spark, sf_dir, ORIGINS), "profile")


HOOKS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'warn' ELSE 'block' END AS mode, CAST(o_custkey % 4 AS INT) AS exit_code, o_orderkey % 3 = 0 AS fail_open FROM {orders}"


@query(f"SELECT id, CASE WHEN mode = 'warn' OR (exit_code = 3 AND fail_open) THEN 0 ELSE exit_code END AS hook_exit_code FROM ({HOOKS}) h")
def hook_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.hook_exit_code(relation(spark, sf_dir, HOOKS)).select("id", "hook_exit_code")


USED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 1 THEN NULL WHEN o_orderkey % 8 = 2 THEN '[]' WHEN o_orderkey % 8 = 3 THEN '{{"in":1.5,"out":2}}' WHEN o_orderkey % 8 = 4 THEN '{{"in":-1,"out":2}}' WHEN o_orderkey % 8 = 5 THEN '{{"in":1,"out":2,"all":4}}' WHEN o_orderkey % 8 = 6 THEN '{{"in":1}}'
ELSE concat('{{"in":', CAST(o_custkey AS STRING), ',"out":2', CASE WHEN o_orderkey % 16 = 7 THEN concat(',"all":', CAST(o_custkey + 2 AS STRING)) ELSE '' END, '}}') END AS usage FROM {{orders}}""".replace("{{", "{").replace("}}", "}")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 IN (0, 7) THEN o_custkey END AS input_tokens, CASE WHEN o_orderkey % 8 IN (0, 7) THEN o_custkey + 2 END AS total_tokens, o_orderkey % 8 BETWEEN 2 AND 6 AS invalid_usage FROM {orders}")
def provider_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.usage(relation(spark, sf_dir, USED), "in", "out", "all").select("id", "input_tokens", "total_tokens", "invalid_usage")


LIMITS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN -1.0 ELSE 10.0 END AS max_bytes, CASE WHEN o_orderkey % 3 = 0 THEN 1.5 ELSE 2.0 END AS max_nodes, CASE WHEN o_orderkey % 7 = 0 THEN -3.0 ELSE 0.0 END AS max_work FROM {orders}"


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'max_bytes' WHEN o_orderkey % 3 = 0 THEN 'max_nodes' WHEN o_orderkey % 7 = 0 THEN 'max_work' END AS invalid_limit FROM {orders}")
def analysis_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, LIMITS).select("id", *(F.col(c).cast("double").alias(c) for c in ("max_bytes", "max_nodes", "max_work")))
    return policy.invalid_limit(rows).select("id", "invalid_limit")



@query("SELECT doc_id, contains(left(text, 8192), chr(0)) AS is_binary FROM {documents} WHERE text IS NOT NULL")
def binary_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "SELECT doc_id, text FROM {documents} WHERE text IS NOT NULL").select("doc_id", content.is_binary(F.col("text").cast("binary")).alias("is_binary"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 90 THEN text ELSE NULL END AS short, strlen(text) > 90 AS was_cut FROM {documents}")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = relation(spark, sf_dir, "SELECT doc_id, text FROM {documents}").withColumn("cut", text.truncate_utf8(90)("text"))
    return cut.select("doc_id", F.when(F.octet_length("text") <= 90, F.col("cut")).alias("short"), (F.endswith("cut", F.lit("...")) & (F.octet_length("text") > 90) & (F.octet_length("cut") <= 90) & F.startswith("text", F.left("cut", F.length("cut") - 3))).alias("was_cut"))


@query("SELECT p_partkey, 'a/' || p_name || ' é\"' AS path FROM {part}")
def quoted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = relation(spark, sf_dir, "SELECT p_partkey, concat('\"a/', p_name, ' \\\\303\\\\251\\\\\"\"') AS q FROM {part}")
    return quoted.select("p_partkey", text.decode_quoted_path("q").alias("path"))


@query("SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0")
def cacheable_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS incomplete, CASE WHEN o_orderkey % 5 = 0 THEN 'INCOMPLETE' ELSE 'WARN' END AS gate, array(CASE WHEN o_orderkey % 7 = 0 THEN 'PROVIDER_TIMEOUT' ELSE 'CACHE_FULL' END) AS codes FROM {orders}")
    return ledger.cacheable(rows).select("id")


BUDGET = "SELECT conv_id AS entity, turn, text FROM {conversations}"


@query("SELECT entity, max(used) <= 3000 AS fits, min(turn) FILTER (used > 3000) AS breach FROM (SELECT conv_id AS entity, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM {conversations}) c GROUP BY entity")
def text_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.text_budget(relation(spark, sf_dir, BUDGET), 3000, "turn", "text")


HEADS = "SELECT o_orderkey AS id, 'change' AS scope, CASE WHEN o_orderkey % 4 = 0 THEN 'repository' ELSE 'change' END AS old_scope, CAST(NULL AS STRING) AS domain, CAST(NULL AS STRING) AS old_domain, 'm' AS model, CASE WHEN o_orderkey % 5 = 0 THEN 'n' ELSE 'm' END AS old_model, '1' AS version, '1' AS old_version, 's' AS signature, CASE WHEN o_orderkey % 7 = 0 THEN 't' ELSE 's' END AS old_signature FROM {orders}"


@query(f"SELECT id, CASE WHEN scope <> old_scope THEN 'scope' WHEN model <> old_model THEN 'model' WHEN signature <> old_signature THEN 'definition' END AS incompatible FROM ({HEADS}) h")
def baseline_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.baseline_incompatibility(relation(spark, sf_dir, HEADS)).select("id", "incompatible")


STORED = "SELECT o_orderkey AS id, array(concat('f', CAST(o_custkey AS STRING)), 'g') AS ids, array(concat('f', CAST(o_custkey AS STRING)), CASE WHEN o_orderkey % 6 = 0 THEN 'h' ELSE 'g' END) AS document_ids, CASE WHEN o_orderkey % 10 = 0 THEN array('g', concat('f', CAST(o_custkey AS STRING))) ELSE array(concat('f', CAST(o_custkey AS STRING)), 'g') END AS finding_document_ids FROM {orders}"


@query("SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey % 6 > 0 AND o_orderkey % 10 > 0")
def consistent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.consistent(relation(spark, sf_dir, STORED)).select("id")


@query("SELECT lang AS kind, count(DISTINCT source) AS n, least(count(DISTINCT source), 7) AS kept, greatest(count(DISTINCT source) - 7, 0) AS overflow FROM {documents} GROUP BY lang")
def path_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.path_sets(relation(spark, sf_dir, "SELECT lang AS kind, source AS path FROM {documents}"), 7)


@query("SELECT doc_id, regexp_replace(replace('Authorization: Bearer tok.' || doc_id || ' and hunter2hunter2', 'hunter2hunter2', '[REDACTED]'), 'tok[.][0-9]+', '[REDACTED]') AS shown FROM {documents}")
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "SELECT doc_id, concat('Authorization: Bearer tok.', CAST(doc_id AS STRING), ' and hunter2hunter2') AS t FROM {documents}")
    return rows.select("doc_id", text.redact(F.col("t"), ("hunter2hunter2",)).alias("shown"))


NOTED = "SELECT c_custkey % 20 AS run, c_custkey AS ordinal, 'C' AS code, c_mktsegment AS stage_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('p/', c_name) END AS path, concat('Bearer key', CAST(c_custkey AS STRING), repeat(' x', CAST(c_custkey % 400 AS INT))) AS message FROM {customer}"


@query(f"""SELECT run, ordinal, code, stage_id, path, CASE WHEN strlen(m) <= 512 THEN m ELSE left(m, 509) || '...' END AS message FROM (SELECT *, regexp_replace(message, 'key[0-9]+', '[REDACTED]') AS m, row_number() OVER (PARTITION BY run ORDER BY ordinal) AS nth FROM ({NOTED.replace('AS INT)', 'AS BIGINT)')}) n) x WHERE nth <= 32""")
def stored_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.stored_diagnostics(relation(spark, sf_dir, NOTED), "run")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['c' || o_custkey] END || ['u'] || [] || CASE WHEN o_orderkey % 2 = 0 THEN ['w'] ELSE [] END AS findings FROM {orders}")
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = relation(spark, sf_dir, "SELECT o_orderkey AS id, o_custkey FROM {orders}").withColumns({"confirmed": F.when(F.col("id") % 3 == 0, none).otherwise(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))), "uncertain": F.array(F.lit("u")), "dismissed": none, "waived": F.when(F.col("id") % 2 == 0, F.array(F.lit("w"))).otherwise(none)})
    return ledger.run_rows(rows).select("id", "findings")


@query("SELECT doc_id, text IS NOT NULL AS valid FROM {documents} WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, false FROM {documents} WHERE doc_id % 3 = 0 AND text IS NOT NULL")
def valid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "SELECT doc_id, CAST(text AS BINARY) AS content FROM {documents} WHERE text IS NOT NULL OR doc_id % 3 > 0")
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit(bytearray(b"\xff")))).otherwise(F.col("content"))
    return rows.select("doc_id", F.coalesce(content.valid_utf8(broken), F.lit(False)).alias("valid"))


@query("SELECT doc_id, '~1' || source || '~0' || lang AS pointer FROM {documents}")
def json_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "SELECT doc_id, source, lang FROM {documents}").select("doc_id", text.json_pointer(F.concat(F.lit("/"), "source", F.lit("~"), "lang")).alias("pointer"))


@query("""SELECT event_id, '{"a":[1,{"k":' || regexp_extract(props, '([0-9]+)', 1) || '}],"é":"' || event_type || '"}' AS canonical FROM {events}""")
def canonical_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "SELECT event_id, concat('{ \"é\": \"', event_type, '\", \"a\": [1, ', props, ']}') AS j FROM {events}")
    return rows.select("event_id", text.canonical_json("j").alias("canonical"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[ ]+', ' ', 'g')) || ' fi' AS block FROM {part}")
def normal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "SELECT p_partkey, concat('  ', upper(p_name), chr(10), ' ﬁ ') AS t FROM {part}").select("p_partkey", text.nfkc_block("t").alias("block"))


MODELS = f"SELECT m.model, v.* FROM (SELECT s_suppkey AS model FROM {{supplier}} WHERE s_suppkey < 20) m CROSS JOIN {R.MINORS} v"


@query("SELECT model AS path, 'm' || model AS model_id, major_id, CAST(major_weight AS INT) AS major_weight, minor_id, CAST(weight AS INT) AS weight, minor_no % 2 = 0 AS required FROM (" + MODELS + ") m")
def score_model_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, MODELS)
    minor = F.struct(F.col("minor_id").alias("id"), F.col("weight").alias("weightTenths"), (F.col("minor_no") % 2 == 0).alias("required"))
    major = rows.groupBy("model", "major_id", "major_weight").agg(F.collect_list(minor).alias("minors")).select("model", F.struct(F.col("major_id").alias("id"), F.col("major_weight").alias("weightTenths"), "minors").alias("j"))
    made = major.groupBy("model").agg(F.collect_list("j").alias("majors")).select(F.col("model").alias("path"), F.to_json(F.struct(F.concat(F.lit("m"), F.col("model").cast("string")).alias("id"), F.lit("1").alias("version"), "majors")).alias("content"))
    return files.score_models(made).drop("version")


@query(f"SELECT entity, CASE WHEN bool_or(status = 'not_assessed') THEN 'N/A' ELSE any_value(n) END AS normalized FROM (SELECT b.entity, status, t.normalized AS n FROM ({R.SUPPLIER_ASSESSMENTS}) b JOIN ({catalog.total_sql(R.SUPPLIER_ASSESSMENTS)}) t ON t.entity = b.entity) x GROUP BY entity")
def published_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.published(scoring.total_scores(scoring.major_scores(catalog.minors(spark, sf_dir, R.SUPPLIER_ASSESSMENTS)))).select("entity", "normalized")


# Instructions: peers in folders, each with one fault.

LONG = "Every change has to keep the tests green and to state what it changes and why, in words that somebody who has not seen the code before can follow."
PEERS = {
    0: ("Read and follow AGENTS.md.", None, None), 1: ("Nothing to see.", "MISSING_CANONICAL_REFERENCE", 1), 2: ("Read and follow ../AGENTS.md.", "WRONG_CANONICAL_SCOPE", 1), 3: ("AGENTS.md is nice.", "MISSING_CANONICAL_DIRECTIVE", 1),
    4: ("Read and follow AGENTS.md. Override AGENTS.md when late.", "EXPLICIT_CANONICAL_CONFLICT", 1), 5: ("Read and follow AGENTS.md.\n\n## Style\n\nTabs.", "UNSCOPED_PEER_CONTENT", 3), 6: (f"Read and follow AGENTS.md.\n\n## Tool-specific rules\n\n{LONG}", "COPIED_SHARED_POLICY", 5),
}
FOLDERS = "SELECT p_partkey AS k, concat('d', CAST(p_partkey AS STRING)) AS folder FROM {part}"


def instruction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canonical document in most folders, and a peer beside it."""
    f = relation(spark, sf_dir, FOLDERS)
    body = F.lit(None).cast("string")
    for i, (t, *_) in PEERS.items():
        body = F.when(F.col("k") % 9 == i, t).otherwise(body)
    own = f.where("k % 9 != 7").select(F.concat("folder", F.lit("/AGENTS.md")).alias("path"), F.lit(f"# Rules\n\n{LONG}").alias("content"), F.lit(None).cast("string").alias("target"))
    peer = f.select(F.concat("folder", F.lit("/CLAUDE.md")).alias("path"), body.alias("content"), F.when(F.col("k") % 9 == 8, F.lit("other/AGENTS.md")).alias("target"))
    return own.unionByName(peer)


@query(f"SELECT folder || '/CLAUDE.md' AS path, {{code}} AS code, CAST({{line}} AS INT) AS line FROM ({FOLDERS}) f WHERE k % 9 <> 0".replace("{code}", "CASE k % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c, _) in PEERS.items() if c) + " WHEN 7 THEN 'ORPHAN_PEER_SCOPE' ELSE 'SYMLINK_TARGET_MISMATCH' END").replace("{line}", "CASE k % 9 " + " ".join(f"WHEN {i} THEN {n}" for i, (_, c, n) in PEERS.items() if c) + " END"))
def instruction_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions.diagnostics(instruction_files(spark, sf_dir))


LINKED = "SELECT DISTINCT concat('n', CAST(l_suppkey AS STRING), '.md') AS src, concat('n', CAST(l_suppkey % 40 AS STRING), '.md') AS dst FROM {lineitem} WHERE l_partkey % 11 = 0"


@query(f"SELECT src, dst FROM ({LINKED}) l WHERE dst IN (SELECT src FROM ({LINKED}) m)")
def instruction_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, LINKED).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- see [x](./"), "dst", F.lit("#top)")))), "\n").alias("content"))
    return instructions.link_edges(rows.withColumnRenamed("src", "path"))


@query(f"SELECT folder, CASE WHEN k % 9 <> 7 THEN folder || '/AGENTS.md' END AS canonical, [folder || '/CLAUDE.md'] AS peers FROM ({FOLDERS}) f ORDER BY folder LIMIT 100")
def instruction_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions.scopes(instruction_files(spark, sf_dir).select("path"), 100)
