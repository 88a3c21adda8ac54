"""Corpus pipeline: toxicity, exact and near duplicates, benchmark passages, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from queryforge.llm import bpe, decontam, exact_dedup, near_dedup, toxicity
from queryforge.llm.common import scratch_path, short_batches

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: A linear model, hashed sketches and a tokenizer are no SQL: the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labelled ones among ``docs``.

    Labels of one class, or none, reject nothing; repeated rows share a decision; a null text scores as an empty one.
    """
    short_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model, threshold=0.7)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then the one with the smallest doc_id (null: last).

    Null and empty texts are one group; rows that repeat an id are separate documents; an empty table stays empty.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, 0.8) stays: the first with the smallest doc_id (null: last).

    Texts without words are linked with nothing and stay; an empty table stays empty.
    """
    short_batches(spark)
    return near_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go when a twentieth of their words or more stands in benchmark passages; texts without words stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as token ids, decoded again: counts and digests; small tables, since the stages share their workers."""
    short_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_tables=False,
                          most_pieces=60_000, most_states=50_000)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("decontamination", drop_benchmark),
          ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batch = spark.conf.get(ARROW_ROWS)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, name.replace(" ", "-"))
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, batch)  # the stages asked for short batches
    return docs
