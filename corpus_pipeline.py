"""The corpus pipeline: toxicity filter, near-duplicate removal, repeated-substring removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peerlens.llm import bpe, decontam, minhash, substrings, toxicity
from peerlens.llm.common import made, release, table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from the labelled documents of the stage's input."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group; documents without words or without doc_id stay, repeated rows stay once."""
    return minhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; every document stays."""
    return substrings.cleaned(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of ids and of the decoded bytes of each document that is left."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: A learned classifier, a merge queue and a suffix sort: tested against brute force (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage's output is written, what the stages so far have stored is dropped."""
    docs, since = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, docs, since)
    return STAGES[-1][1](spark, docs, sf_dir)
