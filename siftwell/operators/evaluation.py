"""Detection quality: labels against observations, per case and in all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def items(text: str) -> Column:
    """The entries of a comma-separated list; null for null."""
    return F.filter(F.split(text, ","), lambda x: x != "")


def case_results(cases: DataFrame) -> DataFrame:
    """A row for each case (id, expected, high, reported, repeats): what is missing, unexpected, repeated, unstable."""
    lists = cases.select(
        "id", F.array_distinct(items("expected")).alias("expected"), F.array_distinct(items("high")).alias("high"), F.coalesce(items("reported"), F.array().cast("array<string>")).alias("reported"),
        F.when(F.col("reported").isNotNull(), F.transform(F.split("repeats", "\\|"), lambda r: F.array_sort(F.array_distinct(F.filter(F.split(r, ","), lambda x: x != ""))))).alias("repeats"),
    )
    base = F.array_sort(F.array_distinct("reported"))
    sized = lists.select(
        "id", F.size("expected").alias("n_expected"), F.size("reported").alias("n_reported"), F.array_sort(F.array_except("expected", "reported")).alias("missing"), F.array_sort(F.array_except("reported", "expected")).alias("unexpected"), (F.size("reported") - F.size(base)).alias("duplicates"),
        F.coalesce(F.size(F.filter("repeats", lambda r: r == base)), F.lit(0)).alias("stable"), F.when(F.col("repeats").isNull(), 0).otherwise(F.size("repeats")).alias("compared"), F.array_sort(F.array_except("high", "reported")).alias("high_misses"),
    )
    exact = (F.size("missing") == 0) & (F.size("unexpected") == 0) & (F.col("duplicates") == 0)
    return sized.withColumn("outcome", F.when(exact, "exact").when(F.col("n_expected") == 0, "false_positive").when(F.size("missing") == F.col("n_expected"), "missed").otherwise("partial"))


def ratio(above: str, below: Column | str, empty: float) -> Column:
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below) if isinstance(below, str) else below), F.lit(empty))


def metrics(results: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, rates and the gate of all cases."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    sums = results.agg(
        F.coalesce(F.sum(F.col("n_expected") - F.size("missing")), F.lit(0)).alias("true_positives"), F.coalesce(F.sum(F.size("unexpected")), F.lit(0)).alias("false_positives"), F.coalesce(F.sum(F.size("missing")), F.lit(0)).alias("false_negatives"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("n_reported"), F.lit(0)).alias("reported"), F.coalesce(F.sum("stable"), F.lit(0)).alias("stable"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"), F.count_if(F.col("n_expected") == 0).alias("clean"), F.coalesce(F.sum(F.size("high_misses")), F.lit(0)).alias("high_severity_misses"),
        *(count(o).alias(f"{o}_cases") for o in ("exact", "partial", "missed", "false_positive")),
    )
    rates = sums.withColumns({
        "precision": ratio("true_positives", F.col("true_positives") + F.col("false_positives"), 1.0), "recall": ratio("true_positives", F.col("true_positives") + F.col("false_negatives"), 1.0), "false_positive_rate": ratio("false_positive_cases", "clean", 0.0),
        "duplicate_rate": ratio("duplicates", "reported", 0.0), "stability": ratio("stable", "compared", 1.0),
    })
    return rates.withColumn("gate", F.when((F.col("high_severity_misses") > 0) | (F.col("false_negatives") > 0), "BLOCK").when((F.col("false_positives") > 0) | (F.col("duplicates") > 0) | (F.col("stability") < 1), "WARN").otherwise("PASS")).drop("stable", "compared", "clean", "reported")


def resources(cases: DataFrame) -> DataFrame:
    """Sums of latency and tokens; values that are missing or below 0 count as 0."""
    good = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0)).cast("bigint").alias(c)
    return cases.where("reported is not null").agg(good("latency_ms"), good("input_tokens"))


def unknown_observations(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations that no case asks for."""
    return observations.join(cases, "id", "left_anti")
