"""Grouping, counting, distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import with_runs


def group_count(frame: DataFrame, key: str) -> DataFrame:
    """(k, n) by the key's string form; orderBy("k") gives the sorted output."""
    return frame.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def group_collect(frame: DataFrame, key: str, value: str) -> DataFrame:
    """(k, values): each key's values in ascending order. The result holds a key's values in one row, so one task gathers them."""
    return frame.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list(value)).alias("values"))


def run_group(frame: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(g, k, n): runs of equal keys in the given order; no rows for no input."""
    return with_runs(frame, key, order, "g").groupBy("g").agg(F.any_value(key).alias("k"), F.count(F.lit(1)).alias("n"))


def run_collect(frame: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(g, k, values): as run_group, with the run's values in order."""
    runs = with_runs(frame, key, order, "g").groupBy("g")
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return runs.agg(F.any_value(key).alias("k"), ordered.alias("o")).select("g", "k", F.col("o.__value").alias("values"))


def word_count(words: DataFrame, column: str = "word") -> DataFrame:
    return words.groupBy(F.col(column).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def distinct(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.dropDuplicates(list(columns)) if columns else frame.distinct()


def distinct_per_partition(frame: DataFrame) -> DataFrame:
    """Each row once for every partition of the frame it stands in; nulls equal nulls. Types that can't be grouped by, as maps, can't be told apart."""
    return frame.withColumn("__partition", F.spark_partition_id()).dropDuplicates(["__partition", *frame.columns]).drop("__partition")
