"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of letters, digits and underscores of any script.
WORD = re.compile(r"\w+")
#: Rows of an id set up to which it is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000
#: Cached entries of a worker's word table before it is emptied; only speed depends on it.
CACHE_WORDS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a temporary one is made, on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="siftwell-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, with its column pruning and row groups for whoever reads it again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, about: int) -> DataFrame:
    """The rows of df, few and large, as a table bucketed by a column of numbers, of which there are about so many.

    Operators that group by the column read it without moving a row. There are no fewer buckets than shuffles have
    partitions, as Spark would move it otherwise. The session's catalog holds its name until the session ends.
    """
    spark, name = df.sparkSession, f"siftwell_{uuid.uuid4().hex}"
    n = min(100_000, max(1, about, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    df.repartition(n, by).write.bucketBy(n, by).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    atexit.register(drop, spark, name)
    return spark.table(name)


def drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended, and its catalog with it
        return


def discard(df: DataFrame) -> None:
    """Removes the files of a table that written made, and lets Spark clean up what only that needed."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def join_ids(df: DataFrame, ids: DataFrame, on: str, how: str, n_ids: int) -> DataFrame:
    """A semi or anti join with a set of ids of a counted size: broadcast while it is small, else shuffled."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids.hint("merge"), on, how)


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with some of its columns exchanged, by name."""
    return pa.RecordBatch.from_arrays([columns.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)
