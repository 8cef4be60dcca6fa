"""Content hashes, the ledger of runs, and the cache of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import framed_hash, redact, truncate_utf8


def snapshot_hash(files: DataFrame, by: str) -> DataFrame:
    """(by, hash) of each group's files (path, content hash), in order of their paths; parts carry their lengths."""
    part = F.concat(F.octet_length("path").cast("string"), F.lit(":"), F.col("path"), F.lit("="), F.col("sha"))
    return files.withColumn("sha", F.sha2(F.col("content").cast("binary"), 256)).groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", part.alias("part")))), lambda x: x["part"]), "\n").cast("binary"), 256).alias("hash"))


def report_hash(findings: DataFrame, by: str) -> DataFrame:
    """(by, hash): the same for any order of the findings."""
    item = F.to_json(F.struct("id", "rule_id", "path", "severity", "lifecycle"), {"ignoreNullFields": "false"})
    return findings.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "\n").cast("binary"), 256).alias("hash"))


def model_signature(model: DataFrame) -> DataFrame:
    """One row: a hash of the model's minors by id."""
    row = F.concat_ws(":", "major_id", F.col("major_weight").cast("string"), "minor_id", F.col("weight").cast("string"))
    return model.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ";").cast("binary"), 256).alias("signature"))


def cache_key(requests: DataFrame, parts: list[str]) -> DataFrame:
    return requests.withColumn("cache_key", framed_hash(*(F.col(p).cast("string") for p in parts)))


def usable(cache: DataFrame, now_ms: int, max_bytes: int = 8 << 20, max_age_ms: int = 7 * 86_400_000) -> DataFrame:
    """Entries under a well-formed key that are small and young enough."""
    return cache.where(F.col("cache_key").rlike(r"^[0-9a-f]{64}\z") & (F.col("bytes") <= max_bytes) & (F.lit(now_ms) - F.col("written_ms")).between(0, max_age_ms))


def missing(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that no usable entry answers."""
    return requests.join(cache, "cache_key", "left_anti")


def cacheable(results: DataFrame) -> DataFrame:
    """Complete results whose gate isn't INCOMPLETE and that no provider's failure marks."""
    return results.where(~F.col("incomplete") & (F.col("gate") != "INCOMPLETE") & ~F.exists("codes", lambda c: c.startswith("PROVIDER_")))


#: Bytes that the ledger keeps of a diagnostic's fields, and how many diagnostics of a run.
KEPT_BYTES, MAX_DIAGNOSTICS = {"stage_id": 120, "path": 256, "message": 512}, 32


def stored_diagnostics(rows: DataFrame, by: str) -> DataFrame:
    """The first diagnostics (by, ordinal, code, stage_id, path, message) of each run, each field without credentials and cut."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("ordinal"))).where(F.col("nth") <= MAX_DIAGNOSTICS).drop("nth")
    return first.withColumns({c: truncate_utf8(n)(redact(F.col(c))) for c, n in KEPT_BYTES.items()})


def run_rows(results: DataFrame) -> DataFrame:
    """Results with their four lists of findings in one, as the ledger keeps them."""
    return results.withColumn("findings", F.concat("confirmed", "uncertain", "dismissed", "waived")).drop("confirmed", "uncertain", "dismissed", "waived")


def consistent(records: DataFrame) -> DataFrame:
    """Records whose three lists of finding ids agree, in order."""
    return records.where((F.col("ids") == F.col("document_ids")) & (F.col("ids") == F.col("finding_document_ids")))


def append_runs(runs: DataFrame, path: str) -> None:
    """Appends to the ledger, partitioned by day; readers prune by it."""
    runs.write.mode("append").partitionBy("day").parquet(path)


def put_cache(entries: DataFrame, path: str) -> None:
    """Appends entries (cache_key, written_ms, ...), under the first two digits of their keys; nothing is replaced."""
    entries.withColumn("shard", F.substring("cache_key", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def cached(entries: DataFrame) -> DataFrame:
    """The newest entry of each key of what put_cache wrote; of those of one moment any, since a key names its content."""
    rest = [c for c in entries.columns if c not in ("cache_key", "shard")]
    return entries.groupBy("cache_key").agg(F.max_by(F.struct(*rest), "written_ms").alias("x")).select("cache_key", "x.*")
