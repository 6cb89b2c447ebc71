"""Column expressions that Spark has no single function for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_split(text: Column, separator: str) -> Column:
    """Split on one character, dropping empty strings at the end; the empty text is one empty field."""
    quoted = "\\t" if separator == "\t" else separator
    trimmed = F.rtrim(text) if separator == " " else F.regexp_replace(text, f"{quoted}+$", "")
    return F.when(text == "", F.array(F.lit(""))).when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, quoted))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def words_of_lines(text: Column) -> Column:
    """java_split at single blanks of every line, all lines' words in one array, so that a text is exploded once."""
    return F.flatten(F.transform(lines(text), lambda line: java_split(line, " ")))


def normalize_url(url: Column) -> Column:
    """Every http://, then every https://, then every www. goes."""
    return reduce(lambda c, part: F.replace(c, F.lit(part), F.lit("")), ("http://", "https://", "www."), url)


def normalize_url_row(row: Column) -> Column:
    """The first three fields of a comma row, the first of them a normalised URL."""
    fields = F.split(row, ",")
    return F.concat_ws(",", normalize_url(fields[0]), fields[1], fields[2])


def normalize_tagged(row: Column, field: str) -> Column:
    """The row of a tagged pair with that field normalised in place, whatever else it holds."""
    return row.withField(field, normalize_url(row[field]))


def tuple_text(*columns: str) -> Column:
    """A row as the text of a tuple: (a,b); nulls read null."""
    return F.concat(F.lit("("), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), F.lit(")"))


def java_hash(text: Column) -> Column:
    """The JVM's 32-bit string hash, for characters of the basic plane."""
    h = F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(4294967296)))
    return F.when(text == "", F.lit(0).cast("bigint")).when(h >= 2147483648, h - 4294967296).otherwise(h)


def bucket_of(hash_value: Column, buckets: int) -> Column:
    """abs(hash) mod buckets in 64 bits, so never negative."""
    return F.abs(hash_value.cast("bigint")) % F.lit(buckets).cast("bigint")
