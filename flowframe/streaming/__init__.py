"""The operators that run on streams, and how to run a bounded stream to its end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.grouping import word_count
from ..sources import words_of


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def streamed_word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """For output modes complete and update."""
    return word_count(words_of(lines, column))


def streamed_distinct(frame: DataFrame, columns: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First occurrences; with an event time the state is dropped after the delay."""
    if event_time:
        return frame.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(columns)
    return frame.dropDuplicates(columns)


def windowed_counts(frame: DataFrame, event_time: str, width: str, key: str, delay: str) -> DataFrame:
    window = F.window(event_time, width)
    return frame.withWatermark(event_time, delay).groupBy(window, key).agg(F.count(F.lit(1)).alias("n"))


def streamed_limit(frame: DataFrame, n: int) -> DataFrame:
    """The first n rows of the stream; what comes later is ignored."""
    return frame.limit(n)


def streamed_scatter(frame: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Round robin over n ports in append mode: each `by` has its own counter, which lives on between batches.

    A batch's rows count in the order of that column. One counter is one task's work; more values of `by` spread it.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields) + ", port int"

    def deal(_, batches, state):
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows["port"] = ((count + pd.RangeIndex(len(rows))) % n).astype("int32")
        state.update((count + len(rows),))
        yield rows

    return frame.groupBy(by).applyInPandasWithState(deal, schema, "count long", "append", GroupStateTimeout.NoTimeout)


def streamed_runs(frame: DataFrame, by: str, key: str, order: str) -> DataFrame:
    """(by, g, k, n) in update mode: runs of equal keys within each `by`, the open run carried to the next batch.

    Every run that a batch begins or prolongs is put out with its count so far; of equal g the latest holds. Keys
    are compared as strings, null with null.
    """
    kind = frame.schema[by].dataType.simpleString()

    def grow(group, batches, state):
        g, last, n = state.get if state.exists else (0, None, 0)
        out = []
        for value in pd.concat(list(batches)).sort_values(order, kind="stable")[key]:
            text = None if pd.isna(value) else str(value)
            if g and text == last:
                n += 1
                out[-1:] = [(g, last, n)]  # in place of the same run, or the batch's first
            else:
                g, last, n = g + 1, text, 1
                out.append((g, last, n))
        state.update((g, last, n))
        yield pd.DataFrame([(group[0], *r) for r in out], columns=["by", "g", "k", "n"])

    return frame.groupBy(by).applyInPandasWithState(grow, f"by {kind}, g long, k string, n long", "g long, k string, n long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(frame: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Take what is there, then stop; the rows are in the in-memory table `name`."""
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
