"""Ordered folds with budgets: what was kept decides what still fits, so running sums don't do.

Each fold is one pass over the rows of its groups, which are brought together and put in order by Spark (and spilled by
it, where they are many); only sizes and flags enter the pass, never contents, and only the state of one group is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf16


def swept(files: DataFrame, by: str, order: str, fields: list[str], decide: Callable[[list, tuple], tuple | None], start: list, out: str) -> DataFrame:
    """(by, order, out): for each row of a group, in order, what decide(state, values of the fields) tells; no row for None.

    The state is a list that decide changes; each group begins with a copy of start.
    """
    schema = f"`{by}` {files.schema[by].dataType.simpleString()}, `{order}` {files.schema[order].dataType.simpleString()}, {out}"
    rows = files.select(by, order, *fields).repartition(by).sortWithinPartitions(by, order)
    shape = files.sparkSession.createDataFrame([], schema).schema
    names = shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, group, state = False, None, []
        for batch in batches:
            kept, told = [], []
            keys = batch.column(0).to_pylist()
            for i, (key, values) in enumerate(zip(keys, zip(*(batch.column(k).to_pylist() for k in range(2, 2 + len(fields)))))):
                if not begun or key != group:
                    begun, group, state = True, key, [*start]
                if (x := decide(state, values)) is not None:
                    kept.append(i)
                    told.append(x)
            at = pa.array(kept, pa.int64())
            columns = [pa.array([x[k] for x in told], types[k]) for k in range(len(types))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=names)

    types = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[f.dataType.simpleString()] for f in shape.fields[2:]]
    return rows.mapInArrow(run, shape)


def greedy_capture(files: DataFrame, by: str = "workspace", max_files: int = 40, max_file_bytes: int = 65_536, max_bytes: int = 524_288) -> DataFrame:
    """(by, ordinal, outcome): the first max_files files in order; each that fits what is left of the bytes is kept.

    files: (by, ordinal, size, reason), reason being why a file isn't read. Too large a file is skipped, and
    later smaller ones may still fit.
    """

    def decide(state: list, row: tuple) -> tuple:
        size, reason = row
        state[0] += 1
        left = max_bytes - state[1]
        if state[0] > max_files:
            return ("file_limit",)
        if reason is not None:
            return (reason,)
        if left < 1:
            return ("aggregate_byte_limit",)
        if size > min(left, max_file_bytes):
            return ("file_limit" if left >= max_file_bytes else "aggregate_byte_limit",)
        state[1] += size
        return ("kept",)

    return swept(files, by, "ordinal", ["size", "reason"], decide, [0, 0], "outcome string")


def greedy_select(files: DataFrame, by: str = "workspace", max_files: int = 5000, max_file_bytes: int = 1 << 20, max_bytes: int = 50 << 20) -> DataFrame:
    """(by, ordinal, outcome): files in order until max_files are selected, each that fits the byte budget.

    files: (by, ordinal, size, flaw), flaw being binary, unsupported_type or suspected_secret. A flawed file uses
    no budget; the limits come before the flaws.
    """

    def decide(state: list, row: tuple) -> tuple:
        size, flaw = row
        if state[0] >= max_files:
            return ("aggregate_file_limit",)
        if size > max_file_bytes:
            return ("file_limit",)
        if state[1] + size > max_bytes:
            return ("aggregate_byte_limit",)
        if flaw is not None:
            return (flaw,)
        state[0] += 1
        state[1] += size
        return ("selected",)

    return swept(files, by, "ordinal", ["size", "flaw"], decide, [0, 0], "outcome string")


def context(files: DataFrame, by: str = "workspace", max_files: int = 40, max_file_bytes: int = 65_536, max_bytes: int = 524_288) -> DataFrame:
    """(by, ordinal, taken, truncated): bytes taken of each of the first files; the last one may be cut.

    files: (by, ordinal, size), size null for one without content, which takes nothing. taken is null for a file
    that is left out.
    """

    def decide(state: list, row: tuple) -> tuple | None:
        (size,) = row
        state[0] += 1
        if state[0] > max_files:
            return None
        limit = min(max_file_bytes, max_bytes - state[1])
        if limit <= 0 or size is None:
            return None, False
        taken = min(limit, size)
        state[1] += taken
        return taken, taken < size

    return swept(files, by, "ordinal", ["size"], decide, [0, 0], "taken bigint, truncated boolean")


def newest_runs(runs: DataFrame, by: str, max_runs: int = 50, max_entry: int = 2 << 20, max_bytes: int = 8 << 20) -> DataFrame:
    """(by, ordinal): runs from the newest on, each that fits the rest of the bytes; broken ones use nothing.

    runs: (by, ordinal, age_rank, size, broken); age_rank 1 is the newest.
    """

    def decide(state: list, row: tuple) -> tuple | None:
        ordinal, size, broken = row
        if state[0] >= max_runs or size > max_entry or state[1] + size > max_bytes or broken:
            return None
        state[0] += 1
        state[1] += size
        return (ordinal,)

    kind = runs.schema["ordinal"].dataType.simpleString()
    return swept(runs, by, "age_rank", ["ordinal", "size", "broken"], decide, [0, 0], f"nth {kind}").select(by, F.col("nth").alias("ordinal"))


def cache_capacity(files: DataFrame, by: str, incoming: DataFrame, max_entries: int = 256, max_bytes: int = 128 << 20, max_age_ms: int = 7 * 86_400_000, max_removals: int = 32) -> DataFrame:
    """(by, age_rank, removed): entries of a cache removed so that another one fits, from the oldest on.

    files: (by, age_rank, age_ms, size, artifact), age_rank 1 being the oldest, without an older entry of the incoming
    key. incoming: (by, bytes). Leftovers of writes
    and entries past their age always go, others while there are too many entries or bytes; at most max_removals go.
    """
    sums = files.groupBy(by).agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    whole = files.join(sums.join(incoming, by).select(by, (F.col("n") + 1).alias("entries"), (F.col("total") + F.col("bytes")).alias("used")), by)

    def decide(state: list, row: tuple) -> tuple | None:
        age, size, artifact, entries, used = row
        if state[0] is None:
            state[:] = [entries, used, 0]
        over = state[0] > max_entries or state[1] > max_bytes
        if state[2] >= max_removals or not (artifact or age > max_age_ms or over):
            return None
        state[0] -= 1
        state[1] -= size
        state[2] += 1
        return (True,)

    return swept(whole, by, "age_rank", ["age_ms", "size", "artifact", "entries", "used"], decide, [None, 0, 0], "removed boolean")


def eviction(runs: DataFrame, by: str, capacity: int, max_removals: int = 32, incoming: DataFrame | None = None) -> DataFrame:
    """(by, ordinal): entries removed so that one more fits, leftovers of writes first, then the oldest.

    runs: (by, ordinal, age, artifact), age growing with time. Leftovers always go, up to max_removals; then the
    oldest until at most ``capacity`` entries with the new one remain. With incoming (by, incoming_age) only entries
    older than the new one go.
    """
    whole = Window.partitionBy(by)
    counted = runs.withColumns({"total": F.count("*").over(whole), "artifacts": F.count_if("artifact").over(whole)})
    if incoming is not None:
        counted = counted.join(incoming, by, "left").where(F.col("artifact") | F.col("incoming_age").isNull() | (F.col("age") < F.col("incoming_age")))
    first = counted.withColumn("nth", F.row_number().over(whole.orderBy(F.desc("artifact"), "age", "ordinal")))
    # Entries with the new one must not exceed capacity; leftovers are gone already.
    excess = F.greatest(F.col("total") + 1 - F.lit(capacity), F.col("artifacts"))
    return first.where(F.col("nth") <= F.least(excess, F.lit(max_removals))).select(by, "ordinal")


def run_capacity(runs: DataFrame, by: str, capacity: int, incoming: DataFrame, max_removals: int = 32) -> DataFrame:
    """(by, removed, accepted): how many entries go for the incoming one, and whether it then fits."""
    gone = eviction(runs, by, capacity, max_removals, incoming).groupBy(by).agg(F.count("*").alias("removed"))
    return runs.groupBy(by).agg(F.count("*").alias("n")).join(gone, by, "left").select(by, F.coalesce("removed", F.lit(0)).alias("removed"), (F.col("n") + 1 - F.coalesce("removed", F.lit(0)) <= capacity).alias("accepted"))


def smallest(rows: DataFrame, by: str, order: list[str], limit: int) -> DataFrame:
    """Rows of each group with kept, true for the ``limit`` smallest."""
    return rows.withColumn("kept", F.row_number().over(Window.partitionBy(by).orderBy(*order)) <= limit)


def bounded_diagnostics(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """(by, ordinal, path, code): at most ``limit`` diagnostics of a group, by path, code and arrival.

    If there are more, the last place tells so instead.
    """
    w = Window.partitionBy(by)
    ranked = rows.withColumns({"ordinal": F.row_number().over(w.orderBy("path", "code", "arrival")), "n": F.count("*").over(w)})
    over = F.col("n") > limit
    return ranked.where(F.col("ordinal") <= limit).select(by, "ordinal", *(F.when(over & (F.col("ordinal") == limit), v).otherwise(F.col(c)).alias(c) for c, v in (("path", "."), ("code", "DIAGNOSTIC_LIMIT_EXCEEDED"))))


def arrival_diagnostics(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """Like bounded_diagnostics, but the first by arrival stay, and are then put in order."""
    early = Window.partitionBy(by).orderBy("arrival")
    kept = rows.withColumns({"nth": F.row_number().over(early), "n": F.count("*").over(Window.partitionBy(by))}).where(F.col("nth") <= limit)
    last = (F.col("n") > limit) & (F.col("nth") == limit)
    named = kept.select(by, "arrival", *(F.when(last, v).otherwise(F.col(c)).alias(c) for c, v in (("path", "."), ("code", "DIAGNOSTIC_LIMIT_EXCEEDED"))))
    return named.select(by, F.row_number().over(Window.partitionBy(by).orderBy(F.col("code") == "DIAGNOSTIC_LIMIT_EXCEEDED", "path", "code", "arrival")).alias("ordinal"), "path", "code")


def repository_review(files: DataFrame, by: str = "workspace", max_shown: int = 200, max_files: int = 40, max_file_bytes: int = 65_536, max_bytes: int = 524_288) -> DataFrame:
    """(by, ordinal, outcome) of a repository's selected files (by, ordinal, size): content, or why it is left out.

    Files beyond max_shown overflow; the first max_files may have content, each that is small enough and fits the rest
    of the bytes.
    """

    def decide(state: list, row: tuple) -> tuple:
        (size,) = row
        state[0] += 1
        if state[0] > max_shown:
            return ("overflow",)
        if state[0] > max_files or size > max_file_bytes:
            return ("file_limit",)
        if state[1] + size > max_bytes:
            return ("aggregate_byte_limit",)
        state[1] += size
        return ("content",)

    return swept(files, by, "ordinal", ["size"], decide, [0, 0], "outcome string")


def metadata_exclusions(files: DataFrame, exclusions: DataFrame, by: str, limit: int = 400) -> DataFrame:
    """(by, ordinal, path, reason): exclusions of a review that reads no content, at most ``limit``.

    Every file (by, ordinal, path, status, is_binary) that could be read comes first, with the first exclusion
    (by, ordinal, path, reason) of its path or else as unsupported; then the other exclusions in their order.
    """
    able = files.where("status != 'deleted' and not is_binary").groupBy(by, "path").agg(F.min("ordinal").alias("place"))
    first = exclusions.where("path is not null").groupBy(by, "path").agg(F.min_by(F.struct("reason", F.col("ordinal").alias("used")), "ordinal").alias("x"))
    needed = able.join(first, [by, "path"], "left").select(by, F.lit(0).alias("rest"), "place", "path", F.coalesce("x.reason", F.lit("unsupported")).alias("reason"), F.col("x.used").alias("used"))
    taken = needed.where("used is not null").select(by, F.col("used").alias("ordinal"))
    others = exclusions.join(taken, [by, "ordinal"], "left_anti").select(by, F.lit(1).alias("rest"), F.col("ordinal").alias("place"), "path", "reason")
    ranked = needed.drop("used").unionByName(others).withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy("rest", "place", "path")))
    return ranked.where((F.col("ordinal") <= limit) | (F.col("rest") == 0)).select(by, "ordinal", "path", "reason")


def attempts(stages: DataFrame, by: str, budget: int = 16, most: int = 2) -> DataFrame:
    """(by, ordinal, reserved): attempts of a budget that each stage (by, ordinal, consumed) gets, in order.

    A stage reserves up to ``most`` of what is left and gives back what it doesn't consume; null for one that finds
    nothing left.
    """

    def decide(state: list, row: tuple) -> tuple:
        (consumed,) = row
        if state[0] < 1:
            return (None,)
        reserved = min(most, state[0])
        state[0] -= min(reserved, consumed)
        return (reserved,)

    return swept(stages, by, "ordinal", ["consumed"], decide, [budget], "reserved int")


def ordered_sources(sources: DataFrame, by: str) -> DataFrame:
    """Sources of settings (by, precedence, source) with their place: by precedence, then by name in UTF-16 order."""
    return sources.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy("precedence", utf16(F.col("source")))))
