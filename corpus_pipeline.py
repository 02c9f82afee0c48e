"""The corpus pipeline: classify, clean, remove near copies, remove repeated passages, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import line_rules, packing, quality_cnn, shingles, simhash, suffix_dedup
from framewise.llm.common import document_shape, documents, write_table
from framewise.llm.queries import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network takes for quality 1; it learns from the labelled ones among ``docs``."""
    model = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return document_shape(quality_cnn.keep_good(docs, model))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their failed lines."""
    return document_shape(line_rules.clean(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints at three or fewer bits, or by 5-word shingles at 0.8 or more."""
    return document_shape(simhash.keep_one(docs, similar=shingles.LEAST))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of fifty or more words that another document keeps."""
    return document_shape(suffix_dedup.cut_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, none of which crosses documents."""
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


#: Rows in one Arrow batch between Spark and a Python worker: whole texts are long, and a worker serves every stage in turn.
ARROW_ROWS = 1000


def _in_small_batches(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (name, _in_small_batches(stage))
    for name, stage in (
        ("quality_classifier", classify), ("quality_rules", clean), ("simhash_near_dedup", drop_near_copies),
        ("suffix_array_dedup", cut_passages), ("packing", pack),
    )
]

#: SQL cannot express the network, the fingerprints, the suffix array or the tokenizer; the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
