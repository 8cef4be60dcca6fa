"""Git captures: raw and numstat records, diff envelopes, snapshots of changed files and their limits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf16
from ..operators.content import valid_path

STATUSES = {"A": "added", "C": "copied", "D": "deleted", "M": "modified", "R": "renamed", "T": "type_changed", "U": "unmerged"}
FIELDS = [("path", pa.string()), ("previous_path", pa.string()), ("status", pa.string()), ("is_binary", pa.bool_()), ("additions", pa.int64()), ("deletions", pa.int64()), ("old_mode", pa.string()), ("new_mode", pa.string()), ("old_object", pa.string()), ("new_object", pa.string()), ("issue", pa.string())]
SQL_FIELDS = "path string, previous_path string, status string, is_binary boolean, additions bigint, deletions bigint, old_mode string, new_mode string, old_object string, new_object string, issue string"
#: A number that a double holds exactly.
SAFE = 2**53 - 1
MAX_FILES, MAX_EXCLUSIONS, MAX_LINES, MAX_DIFF_BYTES = 200, 400, 10_000, 2 << 20


class Malformed(ValueError):
    """Records that don't follow their format; the text names the fault."""


def records(data: bytes) -> list[str]:
    """Texts that each end with NUL."""
    if not data:
        return []
    if data[-1]:
        raise Malformed("not_terminated")
    try:
        return [x.decode() for x in data[:-1].split(b"\0")]
    except UnicodeDecodeError:
        raise Malformed("not_utf8") from None


def counted(data: bytes) -> dict[str, tuple]:
    """Path -> (previous path, is binary, additions, deletions) of numstat records; a rename has two paths of its own."""
    out: dict[str, tuple] = {}
    tokens = iter(records(data))
    for record in tokens:
        parts = record.split("\t", 2)
        if len(parts) < 3 or not parts[0] or not parts[1]:
            raise Malformed("numstat")
        added, deleted, path = parts
        before = None
        if not path:
            before, path = next(tokens, None), next(tokens, None)
            if path is None:
                raise Malformed("numstat_rename")
        binary = added == "-"
        if binary != (deleted == "-"):
            raise Malformed("numstat_binary")
        if not binary and not all(re.fullmatch("[0-9]+", x) and int(x) <= SAFE for x in (added, deleted)):
            raise Malformed("numstat_count")
        if path in out:
            raise Malformed("numstat_duplicate")
        out[path] = (before, binary, None if binary else int(added), None if binary else int(deleted))
    return out


def changed(raw: bytes, numstat: bytes) -> list[tuple]:
    """Files of raw records, each with its numstat record; a rename or copy names two paths in both."""
    stats, out, seen = counted(numstat), [], set()
    tokens = iter(records(raw))
    for header in tokens:
        fields = header[1:].split(" ") if header.startswith(":") else []
        if len(fields) != 5:
            raise Malformed("raw")
        status = STATUSES.get(fields[4][:1])
        if status is None:
            raise Malformed("status")
        moved = status in ("renamed", "copied")
        first = next(tokens, "")
        path = next(tokens, "") if moved else first
        if path not in stats:
            raise Malformed("unmatched")
        if path in seen:
            raise Malformed("raw_duplicate")
        seen.add(path)
        before, binary, added, deleted = stats[path]
        if before != (first if moved else None):
            raise Malformed("rename_paths")
        out.append((path, before, status, binary, added, deleted, *fields[:4], None))
    if len(stats) != len(out):
        raise Malformed("residual")
    return out


def snapshot_files(captures: DataFrame, key: str = "capture_id") -> DataFrame:
    """A row for each file of captures (key, raw, numstat); a capture that is malformed has one row, with its issue alone."""
    kind = captures.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (raw, stat) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                try:
                    found = changed(raw or b"", stat or b"")
                except Malformed as e:
                    found = [(*[None] * (len(FIELDS) - 1), str(e))]
                at += [i] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(FIELDS))], names=[key, *(n for n, _ in FIELDS)])

    return captures.select(key, F.col("raw").cast("binary"), F.col("numstat").cast("binary")).mapInArrow(run, f"`{key}` {kind}, {SQL_FIELDS}")


def split_envelope(output: bytes) -> tuple[bytes, bytes, bytes]:
    """Raw records, numstat records and the patch of one output that holds all three."""
    if not output:
        return b"", b"", b""
    border = output.find(b"\0\0diff --git ")
    if border < 0:
        raise Malformed("no_boundary")
    tokens = records(output[: border + 1])
    k = 0
    while k < len(tokens) and tokens[k].startswith(":"):
        k += 3 if tokens[k].rsplit(" ", 1)[-1][:1] in ("R", "C") else 2
    join = lambda x: "".join(f"{t}\0" for t in x).encode()
    return join(tokens[:k]), join(tokens[k:]), output[border + 2 :]


def envelopes(outputs: DataFrame, key: str = "capture_id") -> DataFrame:
    """(key, raw, numstat, patch, issue) of outputs (key, output)."""
    kind = outputs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    rows.append((*split_envelope(data or b""), None))
                except Malformed as e:
                    rows.append((None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], names=[key, "raw", "numstat", "patch", "issue"])

    return outputs.select(key, F.col("output").cast("binary")).mapInArrow(run, f"`{key}` {kind}, raw binary, numstat binary, patch binary, issue string")


def file_issue(files: DataFrame) -> Column:
    """What makes a snapshot's file invalid: paths, counts, modes or object ids; null for nothing."""
    bad = lambda c, pattern: F.col(c).isNotNull() & ~F.col(c).rlike(pattern)
    path = F.coalesce(~valid_path(F.col("path")), F.lit(True)) | F.coalesce(~valid_path(F.col("previous_path")), F.lit(False))
    count = F.coalesce((F.col("additions") < 0) | (F.col("additions") > SAFE), F.lit(False)) | F.coalesce((F.col("deletions") < 0) | (F.col("deletions") > SAFE), F.lit(False))
    return (
        F.when(path, "path").when(count, "line_count").when(bad("old_mode", r"^[0-7]{6}\z") | bad("new_mode", r"^[0-7]{6}\z"), "mode")
        .when(bad("old_object", r"^[0-9a-f]{40}([0-9a-f]{24})?\z") | bad("new_object", r"^[0-9a-f]{40}([0-9a-f]{24})?\z"), "object_id")
    )


def ordered_files(files: DataFrame, by: str) -> DataFrame:
    """Files with their place in the snapshot, by path and previous path in UTF-16 order."""
    return files.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(utf16(F.col("path")), utf16(F.coalesce("previous_path", F.lit(""))))))


def snapshot_limits(files: DataFrame, exclusions: DataFrame, by: str) -> DataFrame:
    """(by, n_files, n_exclusions, changed_lines, issue): whether a snapshot keeps to its limits; the first fault is told.

    exclusions: (by, path, reason). Diffs are held against diff_issue.
    """
    lines = F.sum(F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0)))
    own = files.withColumn("fault", file_issue(files)).groupBy(by).agg(F.count("*").alias("n_files"), lines.alias("changed_lines"), F.min("fault").alias("fault"))
    reason = (F.octet_length("reason") == 0) | (F.octet_length("reason") > 256) | F.coalesce(~valid_path(F.col("path")), F.lit(False))
    left = exclusions.groupBy(by).agg(F.count("*").alias("n_exclusions"), F.bool_or(reason).alias("wrong"))
    both = own.join(left, by, "full_outer").na.fill(0, ["n_files", "n_exclusions", "changed_lines"])
    over = (F.col("n_files") > MAX_FILES) | (F.col("n_exclusions") > MAX_EXCLUSIONS) | (F.col("changed_lines") > MAX_LINES)
    return both.select(by, "n_files", "n_exclusions", "changed_lines", F.when(over, "limit").when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("wrong"), "exclusion").alias("issue"))


def diff_issue(diff: Column) -> Column:
    return F.when(F.octet_length(diff) > MAX_DIFF_BYTES, "limit")


def parts_hash(*parts: Column) -> Column:
    """SHA-256 of byte strings, each behind its length and a colon; -1: stands for a missing one."""
    framed = [F.when(p.isNull(), F.lit("-1:").cast("binary")).otherwise(F.concat(F.concat(F.octet_length(p).cast("string"), F.lit(":")).cast("binary"), p.cast("binary"))) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def path_set(listings: DataFrame, key: str, most: int, set_label: str = "paths", whole_label: str = "path-sets") -> DataFrame:
    """(key, tracked, untracked, ignored, n_entries, overflow, hash, issue) of listings whose three columns hold paths that each end with NUL.

    At most ``most`` paths are kept in all, of the three sets in this order, each in its own order. The hash covers all
    bytes; labels keep it apart from hashes of other things.
    """
    kinds = ("tracked", "untracked", "ignored")
    raw = {k: F.coalesce(F.col(k).cast("binary"), F.lit("").cast("binary")) for k in kinds}
    good = F.lit(True)
    for k in kinds:
        good &= F.is_valid_utf8(raw[k]) & ((F.octet_length(raw[k]) == 0) | (F.substring(raw[k], -1, 1) == F.lit("\0").cast("binary")))
    entries = {k: F.when(F.octet_length(raw[k]) == 0, F.array().cast("array<string>")).otherwise(F.split(F.decode(F.substring(raw[k], F.lit(1), F.octet_length(raw[k]) - 1), "UTF-8"), "\0", -1)) for k in kinds}
    rows = listings.select(key, good.alias("good"), *(F.when(good, entries[k]).alias(k) for k in kinds), *(F.sha2(F.concat(F.lit(f"{set_label}\0").cast("binary"), raw[k]), 256).alias(f"{k}_hash") for k in kinds))
    before, kept = F.lit(0), []
    for k in kinds:
        kept.append(F.slice(k, F.lit(1), F.least(F.size(k), F.greatest(F.lit(most) - before, F.lit(0)))).alias(k))
        before = before + F.size(k)
    framed = [F.concat(F.size(k).cast("string"), F.lit(":"), F.col(f"{k}_hash"), F.lit("\0")) for k in kinds]
    whole = F.sha2(F.concat(F.lit(f"{whole_label}\0"), *framed).cast("binary"), 256)
    return rows.select(key, *kept, F.when(F.col("good"), before).alias("n_entries"), F.when(F.col("good"), F.greatest(before - most, F.lit(0))).alias("overflow"), F.when(F.col("good"), whole).alias("hash"), F.when(~F.col("good"), "malformed").alias("issue"))
