"""Sources: files as rows, JSON and YAML documents, records of Git plumbing commands."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_SCHEMA = "id string, version string, roundingMode string, majors array<struct<id:string,name:string,weightTenths:int,minors:array<struct<id:string,name:string,weightTenths:int,required:boolean>>>>"


def bounded_files(spark: SparkSession, path: str, max_bytes: int, pattern: str | None = None) -> DataFrame:
    """(path, length, content, issue): files under a folder; too long ones and those that aren't UTF-8 have an issue and no content.

    The length filter runs on the listing, before contents are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    issue = F.when(F.col("length") > max_bytes, "file_limit").when(~F.is_valid_utf8("content"), "not_utf8")
    return files.withColumn("issue", issue).select("path", "length", F.when(F.col("issue").isNull(), F.decode("content", "UTF-8")).alias("content"), "issue")


@F.pandas_udf(T.StringType())
def structured(s: pd.Series) -> pd.Series:
    """YAML or JSON text as JSON; null where it doesn't parse, repeats a key, or nests deeper than 64 levels."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def depth(v, d=0):
        if d > 64:
            raise ValueError("too deep")
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            depth(x, d + 1)
        return v

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(depth(json.loads(x, object_pairs_hook=unique)), ensure_ascii=False)
        except (ValueError, RecursionError):
            pass
        try:
            import yaml  # only where it is installed; JSON needs none
        except ImportError:
            return None

        class Strict(yaml.SafeLoader):
            def construct_mapping(self, node, deep=False):
                keys = [self.construct_object(k, deep=True) for k, _ in node.value]
                if len(set(keys)) < len(keys):
                    raise yaml.YAMLError("repeated key")
                return super().construct_mapping(node, deep)

        try:
            return json.dumps(depth(yaml.load(x, Loader=Strict)), ensure_ascii=False)
        except (yaml.YAMLError, TypeError, ValueError, RecursionError):
            return None

    return s.map(one)


def unknown_keys(document: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON text that aren't allowed; null if it is no object."""
    return F.array_except(F.json_object_keys(document), F.array(*map(F.lit, allowed)))


def score_models(documents: DataFrame) -> DataFrame:
    """(path, model_id, version, major_id, major_weight, minor_id, weight, required) of JSON models (path, content)."""
    m = documents.select("path", F.from_json("content", MODEL_SCHEMA).alias("m")).select("path", F.col("m.id").alias("model_id"), "m.version", F.explode("m.majors").alias("a"))
    return m.select("path", "model_id", "version", F.col("a.id").alias("major_id"), F.col("a.weightTenths").alias("major_weight"), F.explode("a.minors").alias("b")).select("path", "model_id", "version", "major_id", "major_weight", F.col("b.id").alias("minor_id"), F.col("b.weightTenths").alias("weight"), "b.required")


def null_records(text: Column) -> Column:
    """Records that each end with NUL; text after the last one is a fault and gives null."""
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\0")), F.split(F.left(text, F.length(text) - 1), "\0", -1))


def forge_files(rows: DataFrame) -> DataFrame:
    """Files of a pull request's JSON (change_id, body) as snapshot rows; incomplete if the page doesn't hold them all."""
    shape = "changed_files int, files array<struct<filename:string,previous_filename:string,status:string,additions:int,deletions:int>>"
    b = rows.select("change_id", F.from_json("body", shape).alias("b"))
    kinds = F.create_map(*(F.lit(x) for kv in (("added", "added"), ("removed", "deleted"), ("renamed", "renamed"), ("copied", "added")) for x in kv))
    return b.select("change_id", (F.col("b.changed_files") > F.size("b.files")).alias("incomplete"), F.explode("b.files").alias("f")).select("change_id", "incomplete", F.col("f.filename").alias("path"), F.col("f.previous_filename").alias("previous_path"), F.coalesce(F.try_element_at(kinds, F.col("f.status")), F.lit("modified")).alias("status"), F.col("f.additions").alias("added"), F.col("f.deletions").alias("deleted"))


def path_sets(sets: DataFrame, cap: int) -> DataFrame:
    """(kind, n, kept, overflow): entries of each set of paths (kind, path) under one cap for each set."""
    return sets.distinct().groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", F.least("n", F.lit(cap)).alias("kept"), F.greatest(F.col("n") - cap, F.lit(0)).alias("overflow"))


def run_ledger(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Runs of a JSON-lines ledger with a fixed schema; broken lines have broken = true."""
    schema = "run_id string, gate string, incomplete boolean, created_at string, findings array<struct<id:string,severity:string,lifecycle:string>>, _corrupt string"
    runs = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("broken", F.col("_corrupt").isNotNull()).drop("_corrupt")
    return runs if run_id is None else runs.where(F.col("run_id") == run_id)
