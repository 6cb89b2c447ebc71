"""Sinks: print, discard, text, and a probe that counts on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .functions import tuple_text


def printed(frame: DataFrame, port: int = 0) -> DataFrame:
    """line: what print_rows prints of each row that arrives on an input."""
    return frame.select(F.concat(F.lit(f"received on input {port}: "), tuple_text(*frame.columns)).alias("line"))


def print_rows(frame: DataFrame, n: int = 20, port: int = 0) -> None:
    for row in printed(frame, port).take(n):
        print(row["line"])


def forget(frame: DataFrame) -> None:
    """Run the plan, keep nothing."""
    frame.write.format("noop").mode("overwrite").save()


def write_text(frame: DataFrame, path: str, key: str, value: str, mode: str = "errorifexists") -> None:
    """key TAB value lines, committed task by task."""
    frame.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")).write.mode(mode).text(path)


def write_rows(frame: DataFrame, path: str, port: int = 0, mode: str = "errorifexists") -> None:
    """Rows without a key and value of their own: the input's port number is the key, the row's tuple text the value."""
    frame.select(F.concat(F.lit(f"{port}\t"), tuple_text(*frame.columns)).alias("value")).write.mode(mode).text(path)


def write_pairs(frame: DataFrame, kind: str, path: str, mode: str = "errorifexists", **options) -> None:
    """Any format Spark writes."""
    frame.write.format(kind).options(**options).mode(mode).save(path)


def probe(frame: DataFrame, column: str, name: str = "probe") -> tuple[DataFrame, Observation]:
    """The frame, and an observation of its rows and array fields, filled by the first action on it."""
    seen = Observation(name)
    return frame.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(column)), F.lit(0)).cast("bigint").alias("fields")), seen


def probe_rows(frame: DataFrame, column: str, n: int = 0) -> DataFrame:
    """line: the first n arrays that a probe shows, as the frame's order has them; n = 0: all."""
    shown = frame.select(F.array_join(column, ",", "null").alias("line"))
    return shown.limit(n) if n else shown
