"""Bernoulli samples and equi-depth range bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import RANGE, _starts, ranged, with_position
from .partition import range_port

_SPAN = 4294967296


def sample_tee(frame: DataFrame, amount: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """All rows, and a Bernoulli sample of them."""
    if amount >= 1:
        return frame, frame
    return frame, frame.where(F.lit(False)) if amount <= 0 else frame.sample(False, amount, seed)


def sample_by_key(frame: DataFrame, key: str, amount: float, seed: int = 0) -> DataFrame:
    """A sample that any engine repeats: a multiplicative hash of an integer key and the seed, below the share."""
    return frame.where(F.pmod((F.col(key) + F.lit(seed)) * F.lit(2654435761), F.lit(_SPAN)) < F.lit(int(amount * _SPAN)))


def _bounds(frame: DataFrame, column: str, ranges: int) -> list[tuple]:
    """Values at floor(N k / ranges) of the sorted column, each with how many rows are below it."""
    counted = frame.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = ranged(counted, ["v"])
    sizes = [(r[RANGE], r["n"]) for r in dealt.groupBy(RANGE).agg(F.sum("n").alias("n")).collect()]
    total = sum(n for _, n in sizes)
    if total < ranges - 1 or ranges < 2:
        return []
    wanted = [total * k // ranges for k in range(1, ranges)]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(RANGE).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("__inside", before).join(_starts(sizes, frame.sparkSession), RANGE).select("v", "n", (F.col("__inside") + F.col("__start")).alias("at"))
    hit = F.filter(F.array(*[F.lit(w).cast("bigint") for w in wanted]), lambda w: (w >= F.col("at")) & (w < F.col("at") + F.col("n")))
    found = {r["i"]: (r["v"], r["at"]) for r in placed.select("v", "at", F.explode(hit).alias("i")).collect()}
    return [found[i] for i in wanted]


def range_bounds(frame: DataFrame, column: str, ranges: int) -> list:
    """Values at floor(N k / ranges), k = 1 .. ranges - 1, of the sorted column; fewer rows than that: none.

    Equal values are counted before anything is sorted, so a frequent value is one row.
    """
    return [v for v, _ in _bounds(frame, column, ranges)]


def approximate_bounds(frame: DataFrame, column: str, ranges: int, accuracy: int = 10_000) -> list:
    """As range_bounds, in one aggregation and with a relative error of 1 / accuracy."""
    return frame.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], accuracy)).first()[0] or []


def sample_sort(frame: DataFrame, column: str, ties: list[str], ranges: int) -> DataFrame:
    """port and position inside it: the total order in equally full ports.

    Rows are numbered in as many tasks as the session has shuffle partitions, however few ports there are; a port's
    positions start where the ports before it end.
    """
    found = _bounds(frame, column, ranges)
    start: Column = F.array(*[F.lit(n).cast("bigint") for n in (0, *(below for _, below in found))])
    numbered = range_port(with_position(frame, [column, *ties], "__pos"), column, [v for v, _ in found])
    return numbered.withColumn("pos", F.col("__pos") - F.element_at(start, F.col("port") + 1)).drop("__pos")
