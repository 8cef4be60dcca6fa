"""From raw documents to token ids: toxic documents go, near copies go, benchmark passages and personal data are removed, texts are encoded.

Each stage works on all rows that the one before kept. What toxicity leaves is written once, since the search for near
copies reads it more than once; the later stages are one pass over what that keeps.

Defined results, for every stage: a null or empty text stays as it is, with a null or an empty list of token ids at the
end; a null doc_id is compared with nothing and its row stays. Of repeated rows, and of rows with near texts, the one
with the smallest doc_id stays, and of rows with one doc_id and text any. Texts of any length are worked on whole. An
empty table of documents, labels or benchmark items is allowed: without labels nothing is toxic, without items nothing
is removed. Other columns stay, whatever their names, but for token_ids and n_tokens, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import bpe, decontaminate, pii, simhash, toxicity
from siftwell.llm.common import read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a model of the labelled ones doesn't find toxic."""
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all that have none."""
    return simhash.deduplicated(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of benchmark items; n_chars follows the text."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with kinds in brackets in place of personal data; n_chars follows the text."""
    return pii.clean(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids and n_tokens in place of the text."""
    return bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("benchmark_decontamination", remove_benchmark), ("pii", mask_personal_data), ("bpe", encode)]

#: SQL can't express automata, fingerprints and merges; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "toxicity":
            docs = written(docs)
    return docs
