"""Waivers, layered settings, rule packs and providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repository_path, strict_utc


def path_matches(pattern: Column, path: Column) -> Column:
    """dir/** is the directory and all below it, dir/* its own entries, anything else one path."""
    p, c = repository_path(pattern), repository_path(path)
    deep = F.substring(p, F.lit(1), F.length(p) - 3)
    flat = F.substring(p, F.lit(1), F.length(p) - 2)
    below = lambda d: F.startswith(c, F.concat(d, F.lit("/")))
    match = F.when(p.endswith("/**"), (c == deep) | below(deep)).when(p.endswith("/*"), below(flat) & ~F.contains(F.substring(c, F.length(flat) + 2, F.length(c)), F.lit("/"))).otherwise(p == c)
    return F.coalesce(match, F.lit(False))


def applicable_waivers(contexts: DataFrame, waivers: DataFrame, now: str) -> DataFrame:
    """(context_id, waiver_id): waivers in force for a finding.

    Repository and rule are equal, the rule's version lies between two bounds; each scope list that a waiver has
    must hold the context's value. Equality joins on repository and rule; the rest is a residual of the join.
    """
    alive = waivers.where((strict_utc(F.col("expires_at")) > F.lit(now).cast("timestamp")) & (strict_utc(F.col("created_at")) <= F.lit(now).cast("timestamp")))
    c, w = contexts.alias("c"), alive.alias("w")
    scope = lambda items, value: F.col(f"w.{items}").isNull() | F.coalesce(F.array_contains(F.col(f"w.{items}"), F.col(f"c.{value}")), F.lit(False))
    on = (F.col("c.repository") == F.col("w.repository")) & (F.col("c.rule_id") == F.col("w.rule_id")) & F.col("c.rule_version").between(F.col("w.minimum"), F.col("w.maximum")) & (F.col("w.paths").isNull() | F.coalesce(F.exists("w.paths", lambda p: path_matches(p, F.col("c.path"))), F.lit(False))) & scope("findings", "finding_id")
    return c.join(w, on).select(F.col("c.context_id").alias("context_id"), F.col("w.waiver_id").alias("waiver_id"))


def waiver_issues(waivers: DataFrame, now: str, max_days: int = 366) -> DataFrame:
    """(waiver_id, issue) of what a waiver breaks: instants, order, lifetime, bounds, repeated ids."""
    created, expires, at = strict_utc(F.col("created_at")), strict_utc(F.col("expires_at")), F.lit(now).cast("timestamp")
    tests = {
        "created_invalid": created.isNull(), "expires_invalid": expires.isNull(), "expires_before_created": expires <= created, "created_in_future": created > at, "expired": expires <= at,
        "lifetime_too_long": F.date_diff(expires, created) > max_days, "version_range": F.col("minimum") > F.col("maximum"), "duplicate_id": F.col("same_id") > 1, "blank_reason": F.length(F.trim("reason")) < 12,
    }
    counted = waivers.withColumn("same_id", F.count("*").over(Window.partitionBy("waiver_id")))
    return counted.select("waiver_id", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in tests.items())))).alias("issue")).distinct()


def overlay(settings: DataFrame, by: str) -> DataFrame:
    """(by, pointer, value, source): of settings (by, pointer, value, precedence, source) the strongest for each pointer."""
    return settings.groupBy(by, "pointer").agg(F.max_by(F.struct("value", "source"), "precedence").alias("x")).select(by, "pointer", "x.value", "x.source")


def safe(effective: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Numbers under a pointer of limits go no higher; where that lowers one, its source is the safety rule."""
    top = F.lit(None).cast("bigint")
    for pointer, limit in limits.items():
        top = F.when(F.col("pointer") == pointer, F.lit(limit)).otherwise(top)
    lowered = F.coalesce(F.expr("try_cast(value as bigint)") > top, F.lit(False))
    return effective.withColumns({"value": F.when(lowered, top.cast("string")).otherwise(F.col("value")), "source": F.when(lowered, "safety-invariants").otherwise(F.col("source"))})


def first_definitions(rules: DataFrame) -> DataFrame:
    """Rules (rule_id, pack, ordinal) as the first pack defines them, with how many packs repeat them."""
    w = Window.partitionBy("rule_id")
    return rules.withColumns({"nth": F.row_number().over(w.orderBy("ordinal", "pack")), "repeated": F.count("*").over(w) - 1}).where("nth = 1").drop("nth")


def unknown_overrides(overrides: DataFrame, rules: DataFrame) -> DataFrame:
    return overrides.join(rules, "rule_id", "left_anti")


def provider_issues(selections: DataFrame, catalog: DataFrame) -> DataFrame:
    """(selection_id, issue): unknown providers, a model and a policy at once or neither, models that aren't allowed."""
    joined = selections.join(catalog, "provider", "left")
    issue = F.when(F.col("models").isNull(), "untrusted_provider").when(F.col("model").isNull() == F.col("model_policy").isNull(), "model_or_policy").when(F.col("model").isNotNull() & ~F.array_contains("models", F.col("model")), "model_not_allowed")
    return joined.select("selection_id", issue.alias("issue")).where("issue is not null")


#: Codes that say that something couldn't be read to its end, beside all that end in _LIMIT_EXCEEDED.
INCOMPLETE_CODES = [f"CONFIG_{c}" for c in ("RESOLUTION_TOO_LARGE", "READ_FAILED", "CHANGED_DURING_READ")] + [f"WAIVER_{c}" for c in ("LOCATION_CHANGED", "LOCATION_UNSUPPORTED", "DIRECTORY_UNSUPPORTED")]


def diagnostics_status(diagnostics: DataFrame, by: str, groups: DataFrame | None = None) -> DataFrame:
    """(by, gate, invalid): BLOCK if any code is more than an incomplete reading, else INCOMPLETE.

    groups, a relation with the column by, adds those without a diagnostic, which PASS.
    """
    incomplete = F.col("code").isin(INCOMPLETE_CODES) | F.endswith(F.col("code"), F.lit("_LIMIT_EXCEEDED"))
    found = diagnostics.groupBy(by).agg((~F.bool_and(incomplete)).alias("invalid")).withColumn("gate", F.when(F.col("invalid"), "BLOCK").otherwise("INCOMPLETE"))
    if groups is None:
        return found.select(by, "gate", "invalid")
    return groups.select(by).distinct().join(found, by, "left").select(by, F.coalesce("gate", F.lit("PASS")).alias("gate"), F.coalesce("invalid", F.lit(False)).alias("invalid"))


def strongest_gate(gates: DataFrame, by: str) -> DataFrame:
    """The gravest of several gates: PASS, WARN, INCOMPLETE, BLOCK."""
    order = F.array(*map(F.lit, ("PASS", "WARN", "INCOMPLETE", "BLOCK")))
    return gates.groupBy(by).agg(F.element_at(order, F.max(F.array_position(order, F.col("gate"))).cast("int")).alias("gate"))


def exit_code(results: DataFrame) -> DataFrame:
    """What a process ends with: 3 where the result or one of its gates is incomplete, else 1 for the gate BLOCK, else 0.

    results: (gate, incomplete, score_gate); the last two may be missing.
    """
    cut = F.col("gate") == "INCOMPLETE"
    if "incomplete" in results.columns:
        cut |= F.coalesce("incomplete", F.lit(False))
    if "score_gate" in results.columns:
        cut |= F.coalesce(F.col("score_gate") == "INCOMPLETE", F.lit(False))
    return results.withColumn("exit_code", F.when(cut, 3).when(F.col("gate") == "BLOCK", 1).otherwise(0))


def hook_exit_code(results: DataFrame) -> DataFrame:
    """What a hook ends with, from its mode (warn or block), the review's exit code, and whether incomplete reviews let it pass."""
    open_ = (F.col("exit_code") == 3) & F.col("fail_open")
    return results.withColumn("hook_exit_code", F.when((F.col("mode") == "warn") | open_, 0).otherwise(F.col("exit_code")))


def usage(responses: DataFrame, given: str, out: str, total: str | None = None) -> DataFrame:
    """responses (…, usage as JSON) with input_tokens, output_tokens, total_tokens and whether they are invalid.

    Counts are whole numbers of 0 or more that a double holds; a stated total must be their sum. No usage is no fault.
    """
    value_of = lambda f, kind: F.try_variant_get(F.try_parse_json("usage"), f"$.{f}", kind)
    part = lambda f: F.when(F.schema_of_variant(value_of(f, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), value_of(f, "double"))
    fine = lambda c: F.coalesce((c >= 0) & (c <= 2**53 - 1) & (c == F.floor(c)), F.lit(False))
    a, b = part(given), part(out)
    stated = F.array_contains(F.json_object_keys("usage"), total) if total else F.lit(False)
    right = fine(a) & fine(b) & (a + b <= 2**53 - 1) & (~F.coalesce(stated, F.lit(False)) | F.coalesce((part(total) if total else a) == a + b, F.lit(False)))
    bad = F.col("usage").isNotNull() & ~F.coalesce(right, F.lit(False))
    value = lambda c: F.when(F.col("usage").isNotNull() & ~bad, c.cast("bigint"))
    return responses.withColumns({"input_tokens": value(a), "output_tokens": value(b), "total_tokens": value(a + b), "invalid_usage": bad})


def invalid_limit(limits: DataFrame) -> DataFrame:
    """limits with the first of max_bytes, max_nodes and max_work that is no whole number of 0 or more; null for none, and for what isn't set."""
    bad = lambda c: F.coalesce(F.isnan(c) | (F.col(c) < 0) | (F.col(c) != F.floor(c)) | F.col(c).isin(float("inf"), float("-inf")), F.lit(False))
    out = None
    for c in ("max_bytes", "max_nodes", "max_work"):
        out = F.when(bad(c), c) if out is None else out.when(bad(c), c)
    return limits.withColumn("invalid_limit", out)


def publication_identity(label: str = "report") -> Column:
    """The marker line of a comment about (scope, head_sha, report_hash); scope is forge:repository:number."""
    return F.concat(F.lit(f"<!-- {label}:"), F.concat_ws(":", "scope", "head_sha", "report_hash"), F.lit(" -->"))


def publication_action(comments: DataFrame, wanted: DataFrame, label: str = "report") -> DataFrame:
    """(scope, action, comment_id) for each wanted publication (scope, head_sha, report_hash).

    A comment (comment_id, body) belongs to the scope that its first marker line names. One with the very marker is
    reused, the smallest number first, else the smallest numbered of the scope is updated, else one is created. Scopes
    meet in an equality join.
    """
    begin = f"<!-- {label}:"
    lines = F.filter(F.split("body", "\r?\n", -1), lambda x: x.startswith(begin) & x.endswith(" -->"))
    marked = comments.withColumn("marker", F.get(lines, F.lit(0))).where("marker is not null")
    inner = F.substring("marker", F.lit(len(begin) + 1), F.length("marker"))
    # A scope has two colons, and a third one ends it.
    scoped = marked.withColumn("scope", F.substring_index(inner, ":", 3)).where(F.startswith("marker", F.concat(F.lit(begin), F.col("scope"), F.lit(":"))))
    aims = wanted.withColumn("expected", publication_identity(label))
    number = F.col("comment_id").cast("decimal(38,0)")
    found = scoped.join(aims.select("scope", "expected"), "scope").withColumn("same", F.col("marker") == F.col("expected"))
    best = found.groupBy("scope", "expected").agg(F.min(F.struct((~F.col("same")).alias("other"), number.alias("n"), "comment_id")).alias("x"))
    return aims.join(best, ["scope", "expected"], "left").select("scope", F.when(F.col("x").isNull(), "created").when(F.col("x.other"), "updated").otherwise("reused").alias("action"), F.col("x.comment_id").alias("comment_id"))
