"""Partitioners: where rows go (physical), or the number of their port (a column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_of, java_hash
from .order import with_position


def hash_partition(frame: DataFrame, n: int, *columns: str) -> DataFrame:
    """Equal keys share a partition."""
    return frame.repartition(n, *columns)


def scatter(frame: DataFrame, n: int) -> DataFrame:
    return frame.repartition(n)


def range_exchange(frame: DataFrame, n: int, *columns: str) -> DataFrame:
    return frame.repartitionByRange(n, *columns)


def to_ports(frame: DataFrame, n: int, port: str = "port") -> DataFrame:
    """The row with port p goes to partition p."""
    return frame.repartitionById(n, F.col(port).cast("int"))


def port(frame: DataFrame, value: Column, n: int, name: str = "port") -> DataFrame:
    """abs(value) mod n beside each row."""
    return frame.withColumn(name, bucket_of(value, n))


def port_on_key(tagged: DataFrame, n: int, key: str = "row.key", name: str = "port") -> DataFrame:
    """A tagged row's port by the string hash of its key field."""
    return port(tagged, java_hash(F.col(key).cast("string")), n, name)


def scatter_port(frame: DataFrame, order: list[str], n: int, name: str = "port") -> DataFrame:
    """Round robin from port 0 in the order of the columns."""
    return with_position(frame, order, "__pos", first=0).withColumn(name, F.col("__pos") % n).drop("__pos")


def range_port(frame: DataFrame, value: str, bounds: list, name: str = "port") -> DataFrame:
    """How many bounds are not above the value: ranges [low, high), a tie goes up. No bounds: port 0."""
    if not bounds:
        return frame.withColumn(name, F.lit(0))
    kind = frame.schema[value].dataType
    return frame.withColumn(name, F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col(value))))


def custom_partition(frame: DataFrame, function: Callable[[object], int], key: str, n: int, name: str = "port") -> DataFrame:
    """abs(function(key)) mod n for any Python function, called once for each distinct key of an Arrow batch.

    Rows of port p are in partition p. A null key, or a key for which the function gives none, has port 0.
    """

    @F.pandas_udf("int")
    def number(keys):
        made = {k: abs(int(value)) % n if (value := function(k)) is not None else 0 for k in keys.dropna().unique()}
        return keys.map(made).fillna(0).astype("int32")

    return to_ports(frame.withColumn(name, number(F.col(key))), n, name)
