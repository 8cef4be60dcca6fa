"""Fixity audit of WARC replicas by Merkle trees.

A record's digest is the SHA-256 of its bytes. Within a file, records are ordered by their offset; the records
that begin in the same range of ``RANGE`` bytes form a leaf, ``FANOUT`` neighbouring nodes their parent, up to one
root a file. A node's hash is the SHA-256 of its ordered content: offset, length and digest of each record, or
position and hash of each child. The roots of two replicas are compared; below a mismatch, and only there, the
children are compared, down to the records. What differs is named: ``corrupt`` (other bytes at the offset),
``missing`` (no record there in the second replica) or ``extra`` (none in the first).

Defined results: records with a null file or offset are outside of every tree and are left out. A null content
counts as empty; contents of any length are hashed whole. Several records at one offset are one entry, whose digests
are joined in order; a replica that repeats one of them differs. Empty replicas have no nodes; against an empty one
every record is missing or extra, and two empty ones differ in nothing. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

RANGE, FANOUT, HEIGHT = 65_536, 16, 5
#: Records of a WARC file that is made from pages.
PER_FILE = 1000


def pages_as_records(pages: DataFrame, decay: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Digest rows (file_id, offset, record_id, length, digest) of pages written as WARC records, PER_FILE ids to a file.

    decay makes a second replica out of the records (file_id, record_id, content); they keep the offsets that they
    were written at. Contents are hashed where they are read; only sizes and digests are shuffled and sorted.
    """
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    written = pages.where("page_id is not null").select(F.floor(F.col("page_id") / PER_FILE).cast("bigint").alias("file_id"), F.col("page_id").alias("record_id"), F.concat(head, html, F.lit("\r\n\r\n")).alias("content"))
    sized = written.selectExpr("file_id", "record_id", "content", "octet_length(content) as size", "sha2(content, 256) as place")
    now = sized if decay is None else decay(sized)
    kept = now.selectExpr("file_id", "record_id", "size", "place", "cast(octet_length(content) as bigint) as length", "sha2(content, 256) as digest", "lost" if "lost" in now.columns else "false as lost")
    before = "sum(size) over (partition by file_id order by record_id, place rows between unbounded preceding and 1 preceding)"
    return kept.selectExpr("file_id", f"coalesce({before}, 0) as offset", "record_id", "length", "digest", "lost").where("not lost").drop("lost")


def damaged(records: DataFrame) -> DataFrame:
    """A second replica in which some records decayed: changed, cut short or lost."""
    k = F.col("record_id")
    content = F.when(k % 211 == 7, F.concat(F.lit("X"), F.substring("content", 2, 2_000_000_000))).when(k % 307 == 11, F.expr("left(content, length(content) - 4)")).otherwise(F.col("content"))
    return records.withColumns({"content": content, "lost": k % 401 == 13})


def digests(records: DataFrame) -> DataFrame:
    """Digest rows of records (file_id, offset, record_id, content)."""
    return records.select("file_id", "offset", "record_id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("length"), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("digest"))


def entries(rows: DataFrame) -> DataFrame:
    """Digest rows, one for each offset of a file."""
    return rows.where("file_id is not null and offset is not null").groupBy("file_id", "offset").agg(F.min("record_id").alias("record_id"), F.sum("length").alias("length"), F.array_join(F.array_sort(F.collect_list("digest")), "+").alias("digest"))


def ordered_hash(key: str, *parts: str) -> Column:
    """SHA-256 of the rows' parts in the order of the key."""
    row = F.concat_ws(":", F.col(key).cast("string"), *(F.col(p).cast("string") for p in parts))
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("r")))), lambda x: x["r"]), ";"), 256).alias("hash")


def grouped(column: str, by: int) -> Column:
    return F.floor(F.col(column) / by).cast("bigint").alias("node")


def trees(found: DataFrame) -> list[DataFrame]:
    """Levels (replica, file_id, node, hash) of all trees, leaves first; the last has the root of each file."""
    levels = [checkpointed(found.groupBy("replica", "file_id", grouped("offset", RANGE)).agg(ordered_hash("offset", "length", "digest")))]
    for _ in range(HEIGHT - 1):
        below = levels[-1].withColumnRenamed("node", "child")
        levels.append(checkpointed(below.groupBy("replica", "file_id", grouped("child", FANOUT)).agg(ordered_hash("child", "hash"))))
    top = levels[-1].withColumnRenamed("node", "child")
    return [*levels, top.groupBy("replica", "file_id", F.lit(0).cast("bigint").alias("node")).agg(ordered_hash("child", "hash"))]


def mismatches(level: DataFrame) -> DataFrame:
    """(file_id, node) where the replicas have other hashes, or one has no node."""
    return level.groupBy("file_id", "node").agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")).where("n < 2 or low != high").select("file_id", "node")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file_id, offset, record_id, status, expected, actual) of every record that differs between two replicas.

    Each replica is a relation of digest rows (file_id, offset, record_id, length, digest), as digests makes them.
    """
    found = checkpointed(entries(first).withColumn("replica", F.lit(0)).unionByName(entries(second).withColumn("replica", F.lit(1))))
    levels = trees(found)
    bad = mismatches(levels[-1])
    for depth in range(HEIGHT - 1, -1, -1):
        # Every node of the top level has the file's root as its parent, further down FANOUT nodes share one.
        inside = F.lit(0).cast("bigint") if depth == HEIGHT - 1 else F.floor(F.col("node") / FANOUT).cast("bigint")
        parents = bad.select("file_id", F.col("node").alias("parent"))
        bad = mismatches(levels[depth].withColumn("parent", inside).join(parents, ["file_id", "parent"], "left_semi"))
    side = lambda r, c: F.max(F.when(F.col("replica") == r, F.col(c)))
    rows = found.withColumn("node", grouped("offset", RANGE)).join(bad, ["file_id", "node"], "left_semi").groupBy("file_id", "offset").agg(F.coalesce(side(0, "record_id"), side(1, "record_id")).alias("record_id"), side(0, "digest").alias("expected"), side(1, "digest").alias("actual"), side(0, "length").alias("a"), side(1, "length").alias("b"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return rows.where("expected is distinct from actual or a is distinct from b").select("file_id", "offset", "record_id", status.alias("status"), "expected", "actual")


#: The audit's result straight from the records, without trees.
SQL = f"""
WITH records AS (
  SELECT page_id // {PER_FILE} AS file_id, page_id AS record_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS content
  FROM pages WHERE page_id IS NOT NULL
), placed AS (
  SELECT *, coalesce(sum(strlen(content)) OVER (PARTITION BY file_id ORDER BY record_id, sha256(content) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM records
), replica AS (
  SELECT file_id, "offset", record_id, CASE WHEN record_id % 211 = 7 THEN 'X' || substring(content, 2) WHEN record_id % 307 = 11 THEN left(content, length(content) - 4) ELSE content END AS content
  FROM placed WHERE record_id % 401 <> 13
)
SELECT a.file_id AS file_id, CAST(a."offset" AS BIGINT) AS "offset", a.record_id AS record_id,
       CASE WHEN b.content IS NULL THEN 'missing' ELSE 'corrupt' END AS status, sha256(a.content) AS expected, sha256(b.content) AS actual
FROM placed a LEFT JOIN replica b ON a.file_id = b.file_id AND a."offset" = b."offset"
WHERE b.content IS NULL OR sha256(a.content) <> sha256(b.content)
"""
