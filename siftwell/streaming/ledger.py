"""An extension without a counterpart: the run ledger as a stream.

Runs are counted by gate in windows of event time; late ones are dropped beyond the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "run_id string, gate string, created_at timestamp"


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def gates_by_window(runs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(begin, gate, runs); a run that comes twice within the watermark counts once."""
    once = runs.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["run_id"])
    return once.groupBy(F.window("created_at", window), "gate").agg(F.count("*").alias("runs")).select(F.col("window.start").alias("begin"), "gate", "runs")


def keep(runs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = runs.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)
