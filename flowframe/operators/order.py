"""Sorting, positions, limits: a total order without a single-task window.

Rows are dealt to ranges whose borders are quantiles of a bounded sample of rows. Each range is one
partition, sorted and numbered by itself; a table with one row for each range shifts the numbers. The
sample decides only how even the ranges are, never a result. Ties in the order are told apart by a hash
of the whole row, so rows that share a frequent value but not the rest fill several ranges; rows equal in
every column share one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SAMPLE_PER_RANGE = 64
RANGE = "__range"
_TIE = "__tie"


def ranged(frame: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """The frame in one partition a range, with the range's number, which rises with the columns' order (nulls first)."""
    spark = frame.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = frame.withColumn(_TIE, F.xxhash64(*frame.columns) if frame.columns else F.lit(0))
    keys = [*columns, _TIE]
    drawn = tied.select(*keys).orderBy(F.rand(17)).limit(ranges * SAMPLE_PER_RANGE).orderBy(*keys).collect()
    cuts = drawn[SAMPLE_PER_RANGE::SAMPLE_PER_RANGE]
    if not cuts:
        return tied.withColumn(RANGE, F.lit(0)).coalesce(1).drop(_TIE)
    kinds = [tied.schema[c].dataType for c in keys]
    borders = [F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(row, kinds, keys)]) for row in cuts]
    row = F.struct(*[F.col(c) for c in keys])
    # two steps of about the square root of the borders each: the block whose first border isn't above the row, then inside it
    width = math.isqrt(len(borders) - 1) + 1
    blocks = [borders[i : i + width] for i in range(0, len(borders), width)]
    block = F.size(F.filter(F.array(*[b[0] for b in blocks]), lambda b: b <= row))
    inside = F.size(F.filter(F.element_at(F.array(*[F.array(*b) for b in blocks]), F.greatest(block, F.lit(1))), lambda b: b <= row))
    number = F.when(block == 0, 0).otherwise((block - 1) * width + inside)
    return tied.withColumn(RANGE, F.coalesce(number, F.lit(0))).repartitionById(len(cuts) + 1, RANGE).drop(_TIE)


def _starts(sizes: list[tuple[int, int]], spark) -> DataFrame:
    """Where each range's numbers start. One row a range."""
    starts, total = [], 0
    for number, n in sorted(sizes):
        starts.append((number, total))
        total += n
    return F.broadcast(spark.createDataFrame(starts, f"{RANGE} int, __start bigint"))


def with_position(frame: DataFrame, columns: list[str], name: str = "pos", first: int = 1) -> DataFrame:
    """A position column in the order of the columns; ties stand in an order of their own."""
    dealt = ranged(frame, columns)
    sizes = dealt.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))  # combined before the shuffle
    starts = _starts([(r[RANGE], r["n"]) for r in sizes.collect()], frame.sparkSession)
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*columns, F.xxhash64(*frame.columns)))
    numbered = dealt.withColumn("__inside", inside).join(starts, RANGE)
    return numbered.withColumn(name, F.col("__inside") + F.col("__start") + F.lit(first - 1).cast("bigint")).drop(RANGE, "__inside", "__start")


def with_runs(frame: DataFrame, key: str, columns: list[str], name: str = "run") -> DataFrame:
    """A number for each run of equal keys in the order of the columns, from 1.

    Ranges are sorted once and written with their own run numbers, first and last keys; what the ranges before
    add is one row a range.
    """
    order = Window.partitionBy(RANGE).orderBy(*columns, F.xxhash64(*frame.columns))
    own = F.struct(F.col(key).alias("k"))
    fresh = ranged(frame, columns).withColumn("__new", (~F.lag(own).over(order).eqNullSafe(own)).cast("int"))
    inside = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = written(fresh.withColumn("__inside", inside).drop("__new"))
    edges = counted.groupBy(RANGE).agg(F.max("__inside").alias("runs"), F.any_value(F.when(F.col("__inside") == 1, own), True).alias("first"), F.max_by(own, "__inside").alias("last"))
    starts, total, last = [], 0, None
    for r in sorted(edges.collect(), key=lambda r: r[RANGE]):
        total -= last is not None and last == r["first"]  # the range goes on with the run before it
        starts.append((r[RANGE], total))
        total, last = total + r["runs"], r["last"]
    shift = F.broadcast(frame.sparkSession.createDataFrame(starts, f"{RANGE} int, __start bigint"))
    return counted.join(shift, RANGE).withColumn(name, F.col("__inside") + F.col("__start")).select(*frame.columns, name)


def sort(frame: DataFrame, *columns: str, per_partition: bool = False) -> DataFrame:
    return frame.sortWithinPartitions(*columns) if per_partition else frame.orderBy(*columns)


def place_in_partition() -> Column:
    """From 0, the row's place in its partition, as the rows stand."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def merge_sorted(frames: list[DataFrame], *columns: str) -> DataFrame:
    """Sorted inputs merged into one order."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.orderBy(*columns)


def limit(frame: DataFrame, n: int) -> DataFrame:
    return frame.limit(n)


def limit_per_partition(frame: DataFrame, n: int) -> DataFrame:
    """The first n rows of each partition, as they stand."""

    def head(batches):
        left = n
        for batch in batches:
            if left <= 0:
                return
            yield batch.slice(0, left)
            left -= batch.num_rows

    return frame.mapInArrow(head, frame.schema)


def limit_per_key(frame: DataFrame, key: Column, order: list, n: int) -> DataFrame:
    return frame.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def top_k(frame: DataFrame, k: int, *order) -> DataFrame:
    return frame.orderBy(*order).limit(k)


def zip_by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Row i of one input beside row i of the other; what one has more is dropped."""
    a, b = with_position(left, left_order, "__pos"), with_position(right, right_order, "__pos")
    return a.join(b, "__pos").drop("__pos")
