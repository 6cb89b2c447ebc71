"""The corpus pipeline: each stage reads what its predecessor kept; all return the columns of documents, the last one token ids besides."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.llm import compression_quality, disclosure, near_copies, sentencepiece_codec, string_tiling
from flowframe.llm.common import free_name, row_key, shared_dir, table, WIDE, written


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs less those whose `row_key` is among rows."""
    name = free_name(docs, "__row")
    gone = written(rows.toDF("__gone").distinct())
    return docs.withColumn(name, row_key()).join(gone, F.col(name) == F.col("__gone"), "left_anti").drop(name)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = compression_quality.score(docs, model)
    return scored.where(F.col(compression_quality.score_name(docs)) >= compression_quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word likeness 0.8) the document with the smallest id stays, one without an id only if none has one."""
    return _without(docs, near_copies.near_copies(docs).where("not stays").select("row"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whether they have an id or not."""
    found = string_tiling.matched_rows(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("row"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it are replaced in the texts."""
    return disclosure.sanitised(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The clean documents with the ids of their texts, each piece's source bytes, and the texts that the ids decode to.

    Written here, in small batches: those of the session's size took some 200 MB of an executor. Row groups are small too.
    """
    return written(sentencepiece_codec.tokenized(docs, sentencepiece_codec.default_model()), WIDE)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("PII", sanitise),
    ("SentencePiece encoding and decoding", encode),
]

#: Dictionaries and tokenizers are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet in the shared folder and read again: no stage runs twice."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
