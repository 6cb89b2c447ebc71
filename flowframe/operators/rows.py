"""Row by row: identity, filter, tag, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pass_(frame: DataFrame) -> DataFrame:
    return frame


def keep(frame: DataFrame, predicate: Column | str) -> DataFrame:
    return frame.where(predicate)


def tag(frame: DataFrame, n: int) -> DataFrame:
    """(tag, row): the row as a struct under its tag."""
    return frame.select(F.lit(n).alias("tag"), F.struct("*").alias("row"))


def project(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.select(*columns)


def count_fields(frame: DataFrame, key: str, values: str) -> DataFrame:
    """(key, n): how many values a group holds."""
    return frame.select(F.col(key), F.size(values).cast("bigint").alias("n"))


def fan_in(*frames: DataFrame) -> DataFrame:
    """What an operator with several predecessors sees: all rows of all inputs."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
