"""Evidence: an index of the lines of patches, and quotes held against the ranges that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decode_quoted_path, line_slice, nfkc_fold, normal_lines, trimmed
from .findings import conflicts

MAX_RANGE, MIN_QUOTE = 200, 8


def diff_lines(patches: DataFrame) -> DataFrame:
    """(patch_id, side, path, line, content, changed) of unified patches (patch_id, diff).

    A line that begins like a file header is one even inside a hunk. Counters carry on from the last hunk header;
    the last of several entries for a line counts.
    """
    lines = patches.select("patch_id", F.posexplode(F.split("diff", "\r?\n", -1)).alias("n", "raw"))
    w = Window.partitionBy("patch_id").orderBy("n")
    old_header, new_header = F.startswith("raw", F.lit("--- ")), F.startswith("raw", F.lit("+++ "))
    hunk = ~old_header & ~new_header & F.col("raw").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@")
    number = lambda sign: F.when(hunk, F.regexp_extract("raw", rf"^@@ -{'(' if sign == '-' else ''}\d+{')' if sign == '-' else ''}(?:,\d+)? \+{'(' if sign == '+' else ''}\d+{')' if sign == '+' else ''}", 1).cast("int"))
    named = lines.withColumns({"old_raw": F.when(old_header, F.substring("raw", 5, 1 << 30)), "new_raw": F.when(new_header, F.substring("raw", 5, 1 << 30)), "kind": F.when(old_header | new_header, "file").when(hunk, "hunk").otherwise(F.substring("raw", 1, 1)), "old_start": number("-"), "new_start": number("+")})
    # Names are decoded once a header, before they spread over the lines.
    decoded = named.withColumns({"old_path": patch_path("old_raw"), "new_path": patch_path("new_raw")})
    carry = lambda c, flag: F.last(F.when(flag, F.struct(F.col(c).alias("v"))), ignorenulls=True).over(w)["v"]
    carried = decoded.select("patch_id", "n", "raw", "kind", carry("old_path", F.col("old_raw").isNotNull()).alias("old_path"), carry("new_path", F.col("new_raw").isNotNull()).alias("new_path"), F.last("old_start", ignorenulls=True).over(w).alias("old_start"), F.last("new_start", ignorenulls=True).over(w).alias("new_start"), F.sum((F.col("kind") == "hunk").cast("int")).over(w).alias("hunk"))
    inside = Window.partitionBy("patch_id", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    counted = carried.withColumns({s: F.col(f"{s}_start") + F.coalesce(F.sum(F.col("kind").isin(" ", mark).cast("int")).over(inside), F.lit(0)) for s, mark in (("old", "-"), ("new", "+"))})
    sides = counted.select("patch_id", "n", F.substring("raw", 2, 1 << 30).alias("content"), (F.col("kind") != " ").alias("changed"), F.explode(F.array_compact(F.array(*(F.when(F.col("kind").isin(" ", mark), F.struct(F.lit(s).alias("side"), F.col(f"{s}_path").alias("path"), F.col(s).alias("line"))) for s, mark in (("old", "-"), ("new", "+")))))).alias("x"))
    return sides.where("x.path is not null and x.line is not null").groupBy("patch_id", "x.side", "x.path", "x.line").agg(F.max_by(F.struct("content", "changed"), "n").alias("v")).select("patch_id", "side", "path", "line", "v.content", "v.changed")


def patch_path(column: str) -> Column:
    return F.when(F.col(column) != "/dev/null", F.regexp_replace(decode_quoted_path(column), "^[ab]/", ""))


def snapshot_paths(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines under the path that the snapshot has now: by its path, else by its previous path, else as it is."""
    now = files.select("patch_id", "path").distinct().withColumn("present", F.lit(True))
    moved = files.where("previous_path is not null").groupBy("patch_id", F.col("previous_path").alias("path")).agg(F.min("path").alias("to"))
    joined = lines.join(now, ["patch_id", "path"], "left").join(moved, ["patch_id", "path"], "left")
    return joined.withColumn("path", F.when(F.col("present"), F.col("path")).otherwise(F.coalesce("to", "path"))).select(lines.columns)


def location_fault(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates with what is wrong about their place, null for nothing."""
    known = files.select("patch_id", "path").distinct().withColumn("known", F.lit(True))
    fault = (
        F.when(F.col("path").isNull() | F.col("start_line").isNull() | F.col("end_line").isNull(), "incomplete").when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "range_invalid")
        .when(F.col("end_line") - F.col("start_line") + 1 > MAX_RANGE, "range_too_long").when(F.col("known").isNull(), "path_unknown")
    )
    return candidates.join(known, ["patch_id", "path"], "left").withColumn("fault", fault).drop("known")


def captured_ranges(candidates: DataFrame, lines: DataFrame, contents: DataFrame, files: DataFrame) -> DataFrame:
    """(candidate_id, source, text, disposition): what each source holds at a candidate's range, if it has all its lines."""
    good = candidates.where("fault is null")
    wanted = good.select("candidate_id", "patch_id", "path", "start_line", "end_line", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    found = wanted.join(lines, ["patch_id", "path", "line"]).groupBy("candidate_id", "side", "start_line", "end_line").agg(F.count("*").alias("n"), F.bool_or("changed").alias("changed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("text")).where("n = end_line - start_line + 1")
    patch = found.select("candidate_id", F.when(F.col("side") == "new", "diff").otherwise("diff-old").alias("source"), "text", F.when(F.col("changed"), "new").otherwise("preexisting").alias("disposition"))
    status = files.select("patch_id", "path", "status").dropDuplicates(["patch_id", "path"])
    whole = good.join(contents, ["patch_id", "path"]).join(status, ["patch_id", "path"], "left").select("candidate_id", F.lit("context").alias("source"), line_slice(F.col("content"), F.col("start_line"), F.col("end_line")).alias("text"), F.when(F.col("status") == "renamed", "preexisting").when(F.col("status") == "added", "new").otherwise("unknown").alias("disposition"))
    return whole.where("text is not null").unionByName(patch)


def verified(candidates: DataFrame, lines: DataFrame, contents: DataFrame, files: DataFrame) -> DataFrame:
    """(candidate_id, lifecycle, confidence, disposition, unresolved, reason) of quoted candidates.

    A quote must equal the whole range, line by line without outer white space. Candidates that disagree on
    severity, or whose quote isn't found, are uncertain; a blocking one without an independent fact about the same
    range is only corroborated; any other is confirmed.
    """
    placed = location_fault(candidates, files).withColumn("clean", normal_lines(F.coalesce("quote", F.lit(""))))
    ranges = captured_ranges(placed, lines, contents, files)
    preference = F.when(F.col("disposition") == "new", 0).when(F.col("disposition") == "preexisting", 1).otherwise(2)
    source = F.array_position(F.array(F.lit("context"), F.lit("diff"), F.lit("diff-old")), F.col("source"))
    matches = ranges.join(placed.select("candidate_id", "clean"), "candidate_id").groupBy("candidate_id").agg(F.min(F.when(normal_lines(F.col("text")) == F.col("clean"), F.struct(preference.alias("p"), source.alias("o"), "disposition", "source"))).alias("best"))
    keys = ["patch_id", "path", "start_line", "end_line", "key_title"]
    # Null-safe keys: candidates without a place can conflict too.
    keyed = placed.withColumns({"key_title": nfkc_fold("title"), **{k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("path", "start_line", "end_line")}})
    disputed = keyed.join(conflicts(keyed, keys), keys, "left_semi").select("candidate_id").withColumn("disputed", F.lit(True))
    joined = placed.join(matches, "candidate_id", "left").join(disputed, "candidate_id", "left")
    short = F.length("clean") < MIN_QUOTE
    supported = F.col("fault").isNull() & ~short & F.col("best").isNotNull()
    blocking, fact = F.col("severity").isin("P0", "P1"), valid_fact(candidates.columns)
    lifecycle = F.when(F.col("disputed") | ~supported, "uncertain").when(blocking & ~fact, "corroborated").otherwise("confirmed")
    reason = F.when(F.col("disputed"), "conflict").when(F.col("fault").isNotNull(), F.col("fault")).when(short, "quote_short").when(F.col("best").isNotNull(), F.concat(F.lit("matched_"), F.col("best.source"))).otherwise(F.lit("no_match"))
    return joined.withColumn("lifecycle", F.coalesce(lifecycle, F.lit("uncertain"))).select("candidate_id", "lifecycle", F.when(F.col("lifecycle") == "confirmed", "high").otherwise("low").alias("confidence"), F.when(supported, F.col("best.disposition")).otherwise("unknown").alias("disposition"), (F.col("lifecycle") == "corroborated").alias("unresolved"), reason.alias("reason"))


def valid_fact(columns: list[str]) -> Column:
    """Whether an independent fact of a known kind states something about the very range.

    A fact's place is in fact_path, fact_start and fact_end; without these columns facts are about their candidate's range.
    """
    states = F.coalesce(F.col("fact_kind").isin("deterministic", "runtime_contract") & (F.length(trimmed(F.col("fact"))) >= 12), F.lit(False))
    for fact, own in (("fact_path", "path"), ("fact_start", "start_line"), ("fact_end", "end_line")):
        if fact in columns:
            states &= F.col(fact).eqNullSafe(F.col(own))
    return states
