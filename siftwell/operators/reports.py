"""Records that leave: documents of findings and runs, and reports as Markdown and for terminals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, redact, terminal_safe, utf16, utf16_length

#: Rules for findings without one of their own, by stage: subject and number.
SUBJECTS = {"security": ("SEC", 1), "permissions": ("SEC", 2), "concurrency": ("CONC", 1), "readability": ("READ", 1), "testing": ("TEST", 1), "behavior": ("BEH", 1), "universal": ("UNI", 1)}
MAX_ITEMS, SHOWN = 128, 8


def cut(c: Column, units: int) -> Column:
    """The first UTF-16 units of a text; half of a pair at the end goes too."""
    half = F.hex(F.substring(utf16(c), 2 * units - 1, 1)).between("D8", "DB")
    return F.when(utf16_length(c) <= units, c).otherwise(F.decode(F.substring(utf16(c), F.lit(1), F.when(half, 2 * units - 2).otherwise(2 * units)), "UTF-16BE"))


def explanation(value: Column, instead: Column) -> Column:
    """A text without outer white space, or the other one where it is missing or has under 5 UTF-16 units."""
    text = F.regexp_replace(F.coalesce(value, instead), f"^{BLANKS}+|{BLANKS}+$", "")
    return cut(F.when(utf16_length(text) >= 5, text).otherwise(instead), 10_000)


def rule_id(column: Column, stage: Column, prefix: str) -> Column:
    """A rule's id where it is one (prefix, capitals, three digits), else the one that stands for the stage."""
    out = F.when(column.rlike(rf"^{prefix}-[A-Z]+-[0-9]{{3}}\z"), column)
    for name, (subject, n) in SUBJECTS.items():
        out = out.when(stage == name, f"{prefix}-{subject}-{n:03d}")
    return out.otherwise(f"{prefix}-REV-001")


def finding_documents(findings: DataFrame, prefix: str, now: str, provider: str = "unknown", model: str = "unknown") -> DataFrame:
    """Findings (id, rule_id, title, stages, path, ...) with every field of the exported document; missing ones have stand-ins."""
    of = lambda c: F.col(c) if c in findings.columns else F.lit(None).cast("string")
    stage = F.coalesce(F.get("stages", F.lit(0)), F.lit("universal"))
    start, created = F.coalesce("start_line", F.lit(1)), F.coalesce(of("created_at").cast("string"), F.lit(now))
    done = F.when(F.col("lifecycle").isin("confirmed", "reported"), created)
    say = lambda c, instead: explanation(of(c), instead if isinstance(instead, Column) else F.lit(instead))
    return findings.select(
        F.lit("1").alias("schema_version"), "id", rule_id(F.col("rule_id"), stage, prefix).alias("rule_id"), F.lit(1).alias("rule_version"), cut(F.col("title"), 300).alias("title"), "severity", "confidence", F.col("lifecycle").alias("status"), "disposition",
        F.coalesce("path", F.lit("unknown")).alias("path"), start.alias("start_line"), F.coalesce("end_line", start).alias("end_line"),
        say("trigger", F.concat(F.lit("stage:"), stage)).alias("trigger"), say("actual_behavior", F.col("evidence")).alias("actual_behavior"), say("expected_behavior", "Behavior should satisfy project contracts").alias("expected_behavior"), say("impact", "Impact requires assessment").alias("impact"),
        say("evidence", "See code evidence").alias("evidence"), say("remediation", "Remediate with a focused change and tests").alias("remediation"), say("verification", "Verify against snapshot and context evidence").alias("verification"),
        stage.alias("review_stage"), F.coalesce(of("provider"), F.lit(provider)).alias("provider"), F.coalesce(of("model"), F.lit(model)).alias("model"), created.alias("created_at"), done.alias("verified_at"),
    )


def run_documents(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, gate, finding_ids, normalized_tenths, coverage_tenths) of runs: ids of the buckets in their order, shown totals in tenths.

    findings: (run_id, bucket, ordinal, id), bucket being findings, corroborated, uncertain or waived; dismissed ones aren't exported.
    """
    order = F.array_position(F.array(*map(F.lit, ("findings", "corroborated", "uncertain", "waived"))), F.col("bucket"))
    ids = findings.withColumn("place", order).where("place > 0").groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ordinal", "id"))), lambda x: x["id"]).alias("finding_ids"))
    tenths = lambda c: F.floor(F.col(c) * 10 + F.lit(0.5)).cast("bigint")
    return runs.join(ids, "run_id", "left").select("run_id", "gate", F.coalesce("finding_ids", F.array().cast("array<string>")).alias("finding_ids"), tenths("normalized").alias("normalized_tenths"), tenths("coverage").alias("coverage_tenths"))


def markdown_inline(c: Column, limit: int = 2048) -> Column:
    """A text on one line of Markdown: without secrets, nothing unseen, and no sign that would format, link or mention."""
    text = F.regexp_replace(terminal_safe(limit)(redact(c)), r"([\\`*_\[\]{}()#+.!|-])", r"\\$1")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return F.replace(F.regexp_replace(text, r"(?i)\b(https?)://", "$1&#58;//"), F.lit("@"), F.lit("&#64;"))


def listed(rows: DataFrame, by: str, order: list[str], line: Column) -> DataFrame:
    """(by, lines): a text for each row, in order, joined by line feeds."""
    keys = [f"k{i}" for i in range(len(order))]
    each = rows.withColumn("line", line)
    return each.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(k) for o, k in zip(order, keys)), "line"))), lambda x: x["line"]), "\n").alias("lines"))


def markdown_report(runs: DataFrame, findings: DataFrame, heading: str = "Review") -> DataFrame:
    """(run_id, report) of runs (run_id, gate, report_hash, incomplete) with their findings (run_id, bucket, ordinal, ...)."""
    inline = {c: markdown_inline(F.col(c), 300 if c in ("title", "id") else 2048) for c in ("title", "id", "evidence", "impact", "remediation")}
    shown = findings.withColumns({f"{c}_shown": v for c, v in inline.items()})
    say = lambda label, c: F.concat(F.lit(f"\n- {label}: "), F.col(f"{c}_shown"))
    whole = F.concat(F.lit("### "), F.col("severity"), F.lit(": "), F.col("title_shown"), F.lit("\n"), say("ID", "id"), say("Evidence", "evidence"), say("Impact", "impact"), say("Remediation", "remediation"), F.lit("\n"))
    short = F.concat(F.lit("- **"), F.col("severity"), F.lit("** "), F.col("title_shown"), F.lit(" ("), F.col("id_shown"), F.lit(")"))
    out = runs
    buckets = ("findings", "corroborated", "uncertain", "waived")
    for b in buckets:
        part = listed(shown.where(F.col("bucket") == b), "run_id", ["ordinal", "id"], whole if b == "findings" else short)
        out = out.join(part.withColumnRenamed("lines", b), "run_id", "left")
    head = F.concat(F.lit(f"# {heading}\n\n- Gate: **"), F.col("gate"), F.lit("**\n- Run: `"), F.col("run_id").cast("string"), F.lit("`\n- Report hash: `"), F.col("report_hash"), F.lit("`\n- Incomplete: "), F.when(F.col("incomplete"), "yes").otherwise("no"), F.lit("\n\n## Findings\n"))
    body = [F.concat(F.lit("\n"), F.coalesce("findings", F.lit("_No confirmed findings._\n")))]
    body += [F.concat(F.lit(f"\n## {b.capitalize()}\n\n"), F.coalesce(b, F.lit("_None._")), F.lit("\n")) for b in buckets[1:]]
    return out.select("run_id", F.concat(head, *body, F.lit("\n")).alias("report"))


def terminal_report(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, report): the same as plain lines for a terminal, with what each confirmed finding rests on."""
    safe = {c: terminal_safe()(F.col(c)) for c in ("title", "evidence", "path", "verification")}
    shown = findings.withColumns({f"{c}_shown": v for c, v in safe.items()})
    short = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("title_shown"), F.lit(" ("), F.col("id"), F.lit(")"))
    more = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n  {label}: "), F.col(f"{c}_shown"))).otherwise("")
    whole = F.concat(short, more("evidence", "evidence"), more("path", "path"), more("verification", "verification"))
    out, buckets = runs, ("findings", "corroborated", "uncertain", "waived")
    for b in buckets:
        part = listed(shown.where(F.col("bucket") == b), "run_id", ["ordinal", "id"], whole if b == "findings" else short)
        out = out.join(part.withColumnRenamed("lines", b), "run_id", "left")
    yes = lambda a, b: F.when(F.col("incomplete"), a).otherwise(b)
    head = F.concat(F.lit("Gate: "), F.col("gate"), F.lit("\nRun: "), F.col("run_id").cast("string"), F.lit("\nReport: "), F.col("report_hash"), F.lit("\nIncomplete: "), yes("yes", "no"))
    body = [F.concat(F.lit(f"\n\n{b.capitalize()}:\n"), F.coalesce(b, F.lit("- none"))) for b in buckets]
    risk = yes("- Review incomplete; do not treat Gate PASS as full assurance.", "- No structural incompleteness recorded by orchestrator.")
    return out.select("run_id", F.concat(head, *body, F.lit("\n\nResidual risk:\n"), risk, F.lit("\n\n")).alias("report"))


METRICS = "decision_count control_nesting return_count await_count local_declarations catch_count ternary_depth nullish_values nullish_sources large_objects return_shapes broad_classifications implicit_state outcome_distance".split()


def metric_record(measures: DataFrame) -> DataFrame:
    """measures with ``record``: its measures by name; lists count by their length."""
    value = lambda c: F.size(c) if measures.schema[c].dataType.typeName() == "array" else F.col(c)
    own = [c for c in METRICS if c in measures.columns]
    return measures.withColumn("record", F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*(value(c).cast("bigint") for c in own))))


def bounded_report(rows: DataFrame, by: str, limit: int = MAX_ITEMS) -> DataFrame:
    """(by, n, shown, gate): how many candidates and diagnostics of a report are shown; beyond the limit it is incomplete.

    rows: (by, n_candidates, n_diagnostics, gate). If either list is too long, the last diagnostic tells so.
    """
    over = (F.col("n_candidates") > limit) | (F.col("n_diagnostics") > limit)
    return rows.select(by, F.least("n_candidates", F.lit(limit)).alias("candidates"), F.when(over, F.least("n_diagnostics", F.lit(limit - 1)) + 1).otherwise(F.col("n_diagnostics")).alias("diagnostics"), F.when(over, "INCOMPLETE").otherwise(F.col("gate")).alias("gate"))


def ordered_candidates(candidates: DataFrame, by: str) -> DataFrame:
    """Readability candidates with their place: by the offset where they begin, then by rule."""
    return candidates.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy("start_offset", "rule_id")))
