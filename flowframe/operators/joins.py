"""Equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, suffix: str = "_r", merge: bool = False) -> DataFrame:
    """Inner, many to many; both keys stay, and the right side's names get a suffix where they clash.

    merge asks for the sort-merge strategy; else the planner chooses.
    """
    renamed = right.select(*[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns])
    key = right_key + suffix if right_key in left.columns else right_key
    return left.join(renamed.hint("merge") if merge else renamed, left[left_key] == renamed[key], "inner")


def tagged_join(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """(lk, lv, rk, rv): the first input joined with each of the others in turn. Inputs have columns k and v."""
    left = first.select(F.col("k").alias("lk"), F.col("v").alias("lv"))
    rights = reduce(DataFrame.unionByName, [o.select(F.col("k").alias("rk"), F.col("v").alias("rv")) for o in others])
    return left.join(rights, F.col("lk") == F.col("rk"), "inner")
