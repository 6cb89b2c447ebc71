"""What the training-data operators share: reading, checkpoints, null handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names it.

    Only where it is unset (one machine, as in tests) a temporary folder stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="flowframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Rows that a Python worker gets at once while an intermediate table is made: texts of some KB each stay a few MB.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_ROWS rows at most, and shuffle files that go as soon as the table is made; the session's own settings come back afterwards."""
    key, tidy = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = {k: spark.conf.get(k) for k in (key, tidy)}
    if not 0 < int(own[key]) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set(tidy, "true")
    try:
        yield
    finally:
        for k, value in own.items():
            spark.conf.set(k, value)


def lean(run):
    """run, a function of batches, after which its Python worker gives free memory back: Spark keeps workers for later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def cut(frame: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage: later reads survive lost executors."""
    if not frame.sparkSession.sparkContext.getCheckpointDir():
        frame.sparkSession.sparkContext.setCheckpointDir(shared_dir(frame.sparkSession))
    with small_batches(frame.sparkSession):
        return frame.checkpoint(eager=True)


#: For `written` tables of wide rows: a reader holds a row group's rows decoded and a writer gathers them, so a group of Parquet's 128 MB took a heap of 1800 MB.
WIDE = {"parquet.block.size": 8 << 20, "compression": "zstd"}


def written(frame: DataFrame, options: dict | None = None) -> DataFrame:
    """The frame as a table in the shared folder: made once, read as often as wanted, and there when an executor is lost."""
    path = f"{shared_dir(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    with small_batches(frame.sparkSession):
        frame.write.options(**options or {}).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key() -> Column:
    """A number that a second reading of a row (doc_id, text) repeats; rows equal in both share it, rows without an id have it too."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text"))


SALT = 16


def salted(left: DataFrame, right: DataFrame, key: str, *by: str, how: str = "inner") -> DataFrame:
    """Join of many left rows with the one right row of their key; rows of a frequent or null key are dealt to SALT parts by other columns."""
    few = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int")).join(few, [key, "__salt"], how).drop("__salt")


def bit_filter(keys: DataFrame, column: str, bits: tuple[int, int]) -> bytes:
    """Which keys (bigint, evenly spread) there may be, by their last bits: about eight bits a key, between 2^least and 2^most in all.

    Beyond 2^most bits more keys pass by chance. Marked in parts of the table; the driver puts these side by side.
    """
    wanted = (8 * keys.count()).bit_length()
    size = min(max(wanted, bits[0]), bits[1])
    width = 1 << (size - 12)  # rows of 2^12 bits

    def run(batches):
        marks = np.zeros((width, 1 << 9), np.uint8)
        for batch in batches:
            s = batch.column("slot").to_numpy()
            np.bitwise_or.at(marks.reshape(-1), s >> 3, (1 << (s & 7)).astype(np.uint8))
        for i in np.flatnonzero(marks.any(1)).tolist():
            yield pa.RecordBatch.from_pydict({"row": pa.array([i], pa.int32()), "bits": pa.array([marks[i].tobytes()], pa.binary())})

    partitions = min(32, shuffle_partitions(keys.sparkSession))
    spread = keys.select(F.col(column).bitwiseAND((1 << size) - 1).alias("slot")).distinct().repartitionByRange(partitions, "slot")
    out = np.zeros((width, 1 << 9), np.uint8)
    for r in spread.mapInArrow(run, "row int, bits binary").toLocalIterator():
        out[r["row"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def by_bytes(texts: list, limit: int):
    """Slices (start, stop) of a list of strings or bytes with about `limit` units each; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def free_name(frame: DataFrame, name: str) -> str:
    """The name, lengthened by underscores until no column of the frame has it (in any case of letters)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
