"""Queries opN_<name>: each operator over its whole table, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, hmm, merkle, mpeg, mpeg_clips, pii, quality, simhash, toolcalls, toxicity
from .common import read


def op1_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.scan(mpeg_clips.clips(read(spark, sf_dir, "documents")))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return toolcalls.link(toolcalls.calls_of(turns), toolcalls.results_of(turns))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), check=True)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.find(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return merkle.audit(merkle.pages_as_records(pages), merkle.pages_as_records(pages, merkle.damaged))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hmm_scoring, op2_mpeg_audio, op3_tool_calls, op4_bpe, op5_decontamination, op6_simhash_near_dedup, op7_quality_crf, op8_toxicity, op9_warc_merkle_audit, op10_pii)}
ORACLE_SQL = {"op9_warc_merkle_audit": merkle.SQL}
