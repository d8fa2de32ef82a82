"""A pipeline over the documents table: each stage applies one operator to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, language_id, mixing, ngram_join, token_output
from sparkloom.llm.queries import END_ID, MIX_REPEATS, tokenizer_path
from sparkloom.llm.store import read, settle, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """The stage, whole texts going to Python workers a few MB at a time: the workers and executors are the same for all stages."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, by profiles of all labelled documents; those without a letter (`und`) go."""
    return language_id.told(docs, language_id.profiles(docs.select("lang", "text")))


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with linked five-word shingle sets (similarity 0.8), the one with the smallest id."""
    return ngram_join.keep_first(docs)


@_in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id")
    return decontaminate.without(docs, settle(found, "contaminated"))


@_in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources again, until the mix is the flattest that the limit of repeats allows."""
    return mixing.repeat(docs, mixing.mix(docs, repeats=MIX_REPEATS))


@_in_small_batches
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the packed files."""
    return token_output.token_output(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]

# Rank-order profiles, substitution-tolerant overlaps and BPE ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage-{k}")
    return docs
