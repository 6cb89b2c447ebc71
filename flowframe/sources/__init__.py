"""Sources: text in lines, words or tab-separated fields, web pages, tables, constant rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import java_split, words_of_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_lines(spark: SparkSession, path: str | list[str], line_end: str | None = None) -> DataFrame:
    """value: one line; files are split among tasks by Spark. Lines end at a newline, a carriage return or both, or only where line_end says."""
    reader = spark.read.option("lineSep", line_end) if line_end else spark.read
    return reader.text(path)


def words_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """word: each line of the text column, cut at single spaces."""
    return texts.select(F.explode(words_of_lines(F.col(column))).alias("word"))


def word_file(spark: SparkSession, path: str | list[str], line_end: str | None = None) -> DataFrame:
    return words_of(text_lines(spark, path, line_end))


def tsv_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """fields: array of each line's tab-separated fields."""
    return lines.select(java_split(F.col(column), "\t").alias("fields"))


def tsv_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return tsv_fields(text_lines(spark, path))


def mapped(spark: SparkSession, kind: str, path: str | None, mapper: Callable[[DataFrame], DataFrame] | Column, **options) -> DataFrame:
    """Any format Spark reads, passed through a mapper: a DataFrame function, or an array-of-struct column to explode."""
    rows = spark.read.format(kind).options(**options).load(path) if path else spark.read.format(kind).options(**options).load()
    return mapper(rows) if callable(mapper) and not isinstance(mapper, Column) else rows.select(F.inline(mapper))


def hello_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Hello",), ("World",), ("!",)], "word string")


def userlog(spark: SparkSession) -> DataFrame:
    """Constant demonstration rows; what follows a comma keeps its blank."""
    rows = ["text.com, usera, 201101021457", "texta.com, usera, 201101021458", "textb.com, userc, 201101021459", "textc.com, userd, 201101021500"]
    return spark.createDataFrame([tuple(r.split(",")) for r in rows], "site string, user string, ts string")


def websites(spark: SparkSession) -> DataFrame:
    rows = ["text.com, 20000", "texta.com, 30000", "textb.com, 40000", "textc.com, 50000"]
    return spark.createDataFrame([tuple(r.split(",")) for r in rows], "site string, rank string")


class _Url(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _UrlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("path", options.get("urls", "")).split() if u]
        self.tries, self.timeout = int(options.get("tries", 3)), float(options.get("timeout", 30))

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in self.urls]

    def read(self, partition: _Url) -> Iterator[tuple]:
        import time
        import urllib.request

        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(partition.url, timeout=self.timeout) as page:
                    text = page.read().decode(page.headers.get_content_charset() or "utf-8", "replace")
                break
            except OSError:
                if not left:
                    raise
                time.sleep(0.2)
        yield partition.url, text


class WebPages(DataSource):
    """spark.read.format("webpages").load("url url ..."): one task and one row for each URL; option tries, timeout."""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return "url string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _UrlReader(self.options)


def web_words(spark: SparkSession, *urls: str) -> DataFrame:
    """word: all words of the pages, cut at single spaces."""
    spark.dataSource.register(WebPages)
    return words_of(spark.read.format("webpages").load(" ".join(urls)), "content")
