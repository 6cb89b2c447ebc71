"""Sessions with the settings that the pipelines expect, and tables that steps share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "flowframe", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """UTC, adaptive execution and few shuffle partitions: for one machine. Clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir. Only where that is unset, as in tests, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='flowframe-')).rstrip('/')}/work-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in a shared folder: read as often as wanted, made once, and there when an executor is lost."""
    path = work_dir(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
