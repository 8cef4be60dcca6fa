"""Weighted hierarchical scoring: minors to majors to a total, gates, baselines, model checks.

Ratings are half points (0 to 10) and weights tenths, so every sum is an integer; a unit is a five-hundredth of a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import half_up_tenths, signed_tenths_text, tenths_text
from ..plans.relations import MINORS, MODEL

SUMS = ("units", "assessed", "applicable")


def minor_model(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {MINORS}")


def minor_scores(assessments: DataFrame, model: DataFrame) -> DataFrame:
    """Each assessment with its minor's weights and its three integer measures."""
    scored, applies = F.col("status") == "scored", F.col("status") != "not_applicable"
    return assessments.join(model, "minor_id").withColumns({
        "units": F.when(scored, F.col("weight") * F.col("half_points") * 5).otherwise(0).cast("bigint"),
        "assessed": F.when(scored, F.col("weight")).otherwise(0).cast("bigint"),
        "applicable": F.when(applies, F.col("weight")).otherwise(0).cast("bigint"),
    })


def confidence_rank(c: str = "confidence") -> Column:
    return F.when(F.col(c) == "low", 0).when(F.col(c) == "medium", 1).when(F.col(c) == "high", 2)


def confidence_name(rank: Column) -> Column:
    return F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), rank)


def major_scores(minors: DataFrame) -> DataFrame:
    """(entity, major_id): sums, display texts, lowest confidence and common status."""
    sums = minors.groupBy("entity", "major_id").agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMS), F.min(confidence_rank()).alias("rank"), F.min("status").alias("low"), F.max("status").alias("high"), F.bool_or(F.col("status") == "not_assessed").alias("gap"))
    return with_totals(sums).withColumns({"confidence": confidence_name(F.col("rank")), "status": F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed")}).drop("low", "high")


def with_totals(sums: DataFrame) -> DataFrame:
    """Tenths of points earned, of the normalised score and of coverage, and the normalised score as it is shown."""
    return sums.withColumns({
        "earned_tenths": half_up_tenths(F.col("units"), F.lit(500)),
        "normalized_tenths": half_up_tenths(F.col("units") * 2, F.col("assessed")),
        "coverage_tenths": half_up_tenths(F.col("assessed") * 100, F.col("applicable")),
    }).withColumn("normalized", tenths_text(F.col("normalized_tenths")))


def total_scores(majors: DataFrame) -> DataFrame:
    """(entity): the sum of the majors; a gap in a required minor makes the gate INCOMPLETE."""
    sums = majors.groupBy("entity").agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMS), F.min("rank").alias("rank"), F.bool_or("gap").alias("gap"))
    return with_totals(sums).withColumns({"confidence": confidence_name(F.col("rank")), "gate": F.when(F.col("gap"), "INCOMPLETE").otherwise("PASS")}).drop("rank", "gap")


def score(assessments: DataFrame, model: DataFrame) -> DataFrame:
    return total_scores(major_scores(minor_scores(assessments, model)))


def score_gate(totals: DataFrame, context: DataFrame) -> DataFrame:
    """BLOCK of the context or a confirmed blocking finding wins over a gap, a gap over the context's gate."""
    joined = totals.join(context, "entity", "left")
    gate = F.when((F.col("context_gate") == "BLOCK") | F.coalesce("blocking", F.lit(False)), "BLOCK").when((F.col("context_gate") == "INCOMPLETE") | (F.col("gate") == "INCOMPLETE"), "INCOMPLETE").otherwise(F.coalesce("context_gate", F.lit("PASS")))
    return joined.select("entity", gate.alias("gate"))


def published(totals: DataFrame) -> DataFrame:
    """A total with a required gap shows no normalised score."""
    return totals.withColumn("normalized", F.when(F.col("gate") == "INCOMPLETE", "N/A").otherwise(F.col("normalized")))


def minor_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Minors of two scored relations side by side: why they compare or don't, and the earned difference."""
    old = baseline.select("entity", "minor_id", F.col("status").alias("old_status"), F.col("units").alias("old_units"))
    reason = F.when(F.col("status") != F.col("old_status"), "assessment_status_changed").when(F.col("status") == "scored", "numeric_delta").otherwise(F.concat(F.col("status"), F.lit("_unchanged_non_numeric")))
    delta = F.col("units") - F.col("old_units")
    shown = F.when(F.col("reason") == "numeric_delta", signed_tenths_text(delta, F.lit(500))).when(F.col("reason") == "assessment_status_changed", "state changed").otherwise(F.concat(F.replace(F.col("status"), F.lit("_"), F.lit(" ")), F.lit(" unchanged")))
    return current.join(old, ["entity", "minor_id"]).withColumn("reason", reason).select("entity", "minor_id", "major_id", "reason", F.when(F.col("reason") == "numeric_delta", delta).alias("delta_units"), shown.alias("shown"))


def major_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Majors of two scored relations: comparable only if every minor kept its status."""
    old = baseline.select("entity", "minor_id", *(F.col(c).alias(f"old_{c}") for c in ("status", "units", "assessed")))
    both = current.join(old, ["entity", "minor_id"]).groupBy("entity", "major_id").agg(
        F.bool_and(F.col("status") == F.col("old_status")).alias("same"), *(F.sum(c).cast("bigint").alias(to) for c, to in (("units", "new_units"), ("assessed", "new_assessed"), ("old_units", "old_units"), ("old_assessed", "old_assessed"))),
    )
    above, below = normalized_delta()
    return both.select("entity", "major_id", (F.col("same") & (below > 0)).alias("comparable"), F.when(~F.col("same"), "state changed").otherwise(signed_tenths_text(above, below)).alias("shown"))


def normalized_delta() -> tuple[Column, Column]:
    """Numerator and denominator of the difference of two normalised scores."""
    return F.col("new_units") * 2 * F.col("old_assessed") - F.col("old_units") * 2 * F.col("new_assessed"), F.col("new_assessed") * F.col("old_assessed")


def baseline_incompatibility(headers: DataFrame) -> DataFrame:
    """Why the baseline of each pair of result headers can't be compared, null if it can."""
    reason = F.when(~F.col("scope").eqNullSafe(F.col("old_scope")) | ~F.col("domain").eqNullSafe(F.col("old_domain")), "scope").when((F.col("model") != F.col("old_model")) | (F.col("version") != F.col("old_version")), "model").when(F.col("signature") != F.col("old_signature"), "definition")
    return headers.withColumn("incompatible", reason)


def focused(minors: DataFrame, domain: str) -> DataFrame:
    """Scores of one major alone; the filter reaches the join with the model."""
    return minors.where(F.col("major_id") == domain)


def overridden(model: DataFrame, overrides: DataFrame) -> DataFrame:
    """The model with weights (id, weight) of a profile for minors and majors."""
    minor = overrides.select(F.col("id").alias("minor_id"), F.col("weight").alias("new_minor"))
    major = overrides.select(F.col("id").alias("major_id"), F.col("weight").alias("new_major"))
    joined = model.join(minor, "minor_id", "left").join(major, "major_id", "left")
    return joined.withColumns({"weight": F.coalesce("new_minor", "weight"), "major_weight": F.coalesce("new_major", "major_weight")}).select(model.columns)


def model_issues(model: DataFrame) -> DataFrame:
    """(code, subject) of what is wrong with a model: sets, sums, weights, repeated and missing names."""
    expected = F.array(*(F.lit(m) for m, *_ in MODEL))
    majors = model.groupBy("major_id").agg(F.max("major_weight").alias("weight"), F.sum("weight").alias("minors"))
    issues = [
        majors.where(F.col("minors") != F.col("weight")).select(F.lit("MINOR_TOTAL_MISMATCH").alias("code"), F.col("major_id").alias("subject")),
        majors.where("weight is null or weight <= 0").select(F.lit("INVALID_MAJOR_WEIGHT"), "major_id"),
        model.where("weight is null or weight <= 0").select(F.lit("INVALID_MINOR_WEIGHT"), "minor_id"),
        model.where("trim(minor_id) = '' or minor_id is null").select(F.lit("UNNAMED_MINOR"), "major_id"),
        model.groupBy("minor_id").count().where("count > 1").select(F.lit("DUPLICATE_MINOR_ID"), "minor_id"),
        majors.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"), F.array_sort(F.collect_set("major_id")).alias("ids")).select(F.explode(F.array_compact(F.array(F.when(F.col("total") != 1000, F.struct(F.lit("MAJOR_TOTAL_INVALID").alias("code"), F.lit("majors").alias("subject"))), F.when(F.col("ids") != F.array_sort(expected), F.struct(F.lit("MAJOR_SET_INVALID").alias("code"), F.lit("majors").alias("subject")))))).alias("x")).select("x.code", "x.subject"),
    ]
    out = issues[0]
    for i in issues[1:]:
        out = out.union(i)
    return out


def cover_issues(assessments: DataFrame, model: DataFrame) -> DataFrame:
    """(entity, minor_id, issue): minors without an assessment, assessed twice, or unknown to the model."""
    grid = assessments.select("entity").distinct().crossJoin(model.select("minor_id")).withColumn("known", F.lit(True))
    found = assessments.groupBy("entity", "minor_id").agg(F.count("*").alias("n"))
    issue = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return grid.join(found, ["entity", "minor_id"], "full_outer").select("entity", "minor_id", issue.alias("issue")).where("issue is not null")


def text_budget(assessments: DataFrame, limit: int, order: str, text: str) -> DataFrame:
    """(entity, fits): whether the bytes of all texts stay within the limit, and at which row they leave it."""
    running = F.sum(F.octet_length(text)).over(Window.partitionBy("entity").orderBy(order))
    return assessments.select("entity", order, running.alias("used")).groupBy("entity").agg((F.max("used") <= limit).alias("fits"), F.min(F.when(F.col("used") > limit, F.col(order))).alias("breach"))
