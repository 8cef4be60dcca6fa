"""Readability rules over measured units (functions, try blocks, files), against a baseline by structural id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measures that rules 4 to 8 compare; a unit is expanded if any of them grew, improved if some only shrank.
COMPARED = {
    "CQ-READ-004": "ternary_depth nullish_values nullish_sources mixed", "CQ-READ-005": "state_keys state_variants", "CQ-READ-006": "result_properties result_shapes", "CQ-READ-007": "error_string_tests", "CQ-READ-008": "outcome_distance decisions awaits returns",
}
MEASURES = "ternary_depth nullish_values nullish_sources mixed state_keys state_variants result_properties result_shapes error_string_tests outcome_distance decisions awaits returns".split()


def scalar_class(now: str, before: str) -> Column:
    return F.when(F.col(before).isNull(), "new").when(F.col(now) > F.col(before), "expanded").when(F.col(now) < F.col(before), "improved").otherwise("unchanged")


def vector_class(names: list[str]) -> Column:
    pairs = F.array(*(F.struct(F.col(n).alias("a"), F.col(f"old_{n}").alias("b")) for n in names))
    return F.when(F.col("old_lines").isNull(), "new").when(F.exists(pairs, lambda p: p["a"] > F.coalesce(p["b"], F.lit(0))), "expanded").when(F.exists(pairs, lambda p: p["a"] < F.coalesce(p["b"], F.lit(0))), "improved").otherwise("unchanged")


def identity_issues(units: DataFrame) -> DataFrame:
    """(file_id, kind, symbol_id) of structural ids that a file has more than once."""
    return units.groupBy("file_id", "kind", "symbol_id").count().where("count > 1").drop("count")


def candidates(units: DataFrame, baseline: DataFrame) -> DataFrame:
    """(file_id, symbol_id, offset, rule_id, severity, class, impact): units that a rule asks about.

    units: (file_id, kind, symbol_id, offset, lines and the measures); of repeated ids in the baseline the first
    counts.
    """
    old = baseline.groupBy("file_id", "kind", "symbol_id").agg(F.min_by(F.struct("lines", *MEASURES), "offset").alias("o")).select("file_id", "kind", "symbol_id", F.col("o.lines").alias("old_lines"), *(F.col(f"o.{m}").alias(f"old_{m}") for m in MEASURES))
    both = units.join(old, ["file_id", "kind", "symbol_id"], "left").withColumn("size_class", scalar_class("lines", "old_lines"))
    is_, lines, fresh = lambda k: F.col("kind") == k, F.col("lines"), F.col("size_class").isin("new", "expanded")
    new = F.col("size_class") == "new"
    large = (lines > 150) & fresh
    nullish = (F.col("nullish_values") >= 3) & ((F.col("nullish_sources") >= 2) | (F.col("mixed") > 0))
    hard = is_("function") & new & (lines > 300)
    rules = [
        ("CQ-READ-001", is_("function") & (lines > 80), F.when(hard, "P1").when(large, "P2").otherwise("P3"), F.col("size_class"), hard | large),
        ("CQ-READ-002", is_("file") & (lines > 600) & new, F.when(lines > 1000, "P1").otherwise("P3"), F.col("size_class"), lines > 1000),
        ("CQ-READ-003", is_("try") & (lines > 80), F.when(large, "P2").otherwise("P3"), F.col("size_class"), large),
        ("CQ-READ-004", is_("function") & ((F.col("ternary_depth") >= 2) | nullish | (F.col("mixed") > 0)), None, None, None),
        ("CQ-READ-005", is_("function") & (F.col("state_keys") > 0) & (F.col("state_variants") >= 3), None, None, None),
        ("CQ-READ-006", is_("function") & ((F.col("result_properties") >= 8) | (F.col("result_shapes") >= 2)), None, None, None),
        ("CQ-READ-007", is_("function") & (F.col("error_string_tests") > 0), None, None, None),
        ("CQ-READ-008", is_("function") & (F.col("outcome_distance") > 80) & (F.col("decisions") > 0) & (F.col("awaits") > 0) & (F.col("returns") > 0), None, None, None),
    ]
    hits = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(rule).alias("rule_id"), (F.lit("P3") if severity is None else severity).alias("severity"), (vector_class(COMPARED[rule].split()) if kind is None else kind).alias("class"), F.when(F.lit(False) if block is None else block, "block").otherwise("warn").alias("impact"))) for rule, test, severity, kind, block in rules)))
    return both.select("file_id", "symbol_id", "offset", F.explode(hits).alias("x")).select("file_id", "symbol_id", "offset", "x.*")


def gates(units: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, gate, n): a repeated identity makes a file INCOMPLETE; else its gravest candidate decides."""
    broken = identity_issues(units).select("file_id").distinct().withColumn("broken", F.lit(True))
    summed = found.groupBy("file_id").agg(F.bool_or(F.col("impact") == "block").alias("block"), F.count("*").alias("n"))
    return units.select("file_id").distinct().join(summed, "file_id", "left").join(broken, "file_id", "left").select("file_id", F.when(F.col("broken"), "INCOMPLETE").when(F.col("block"), "BLOCK").when(F.col("n") > 0, "WARN").otherwise("PASS").alias("gate"), F.when(F.col("broken"), 0).otherwise(F.coalesce("n", F.lit(0))).alias("n"))


def structural_ids(nodes: DataFrame) -> DataFrame:
    """Nodes (file_id, parent, base, ordinal) with ids that number equal names under a parent."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("file_id", "parent", "base").orderBy("ordinal"))
    return nodes.withColumn("symbol_id", F.concat_ws("/", "parent", F.concat("base", F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise(""))))


def outcome_distance(marks: DataFrame) -> DataFrame:
    """(file_id, symbol_id, distance): the furthest that a decision is from an awaited effect or outcome, in lines.

    marks: (file_id, symbol_id, kind, line), kind being decision or outcome; 0 where either is missing.
    """
    at = lambda f, k: f(F.when(F.col("kind") == k, F.col("line")))
    wide = marks.groupBy("file_id", "symbol_id").agg(at(F.min, "decision").alias("d0"), at(F.max, "decision").alias("d1"), at(F.min, "outcome").alias("o0"), at(F.max, "outcome").alias("o1"))
    return wide.select("file_id", "symbol_id", F.coalesce(F.when(F.col("d0").isNotNull() & F.col("o0").isNotNull(), F.greatest(F.abs(F.col("d1") - F.col("o0")), F.abs(F.col("o1") - F.col("d0")))), F.lit(0)).alias("distance"))
