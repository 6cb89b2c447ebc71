"""WARC archives in which repeated payloads become revisit records.

Only headers (id, digest) are shuffled to find, for each payload digest, the record that keeps the
payload; the decisions about the others are a table of its own, so payloads move only where that table
is too large for the planner to broadcast. Archives are written by Spark's committed text writer: each
file begins with a warcinfo record, is one gzip member, and ends its records by CRLF CRLF, so any file
system that Spark reaches will do and a lost task is written anew. Headers are fresh: every record has the
date of this writing. Reading streams: Spark cuts the unzipped bytes at CRLF CRLF, and the records are put
together again by Content-Length, whatever the payload holds, so no file is ever held whole.

Defined results: null html is the empty payload; a null url is left out of the headers and control
characters in it are percent-encoded; rows that repeat both the largest page_id and the payload are all
responses (a record doesn't revisit itself), other repeated rows all revisit; a null page_id ranks below every
other. Columns other than page_id, url and html are left out, so none can clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

CRLF = "\r\n"
MIN_PAYLOAD = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of a SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":sha1:"), digest, F.lit(">"))


def _pages(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url"),
        html.alias("html"),
        base32_sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("bigint").alias("n"),
    )


def revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, digest, first_id) of the records that another record with the same payload replaces."""
    headers = _pages(pages).where(F.col("n") >= min_payload).select("page_id", "digest")
    kept = headers.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first_id is not null")
    others = headers.distinct().join(kept.drop("copies"), "digest")
    return others.where("page_id is null or page_id < first_id").select("page_id", "digest", "first_id")


def write(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Write archives under folder/archives; the decisions stand beside them under folder/revisits."""
    spark = pages.sparkSession
    revisits(pages, min_payload).write.parquet(f"{folder}/revisits")
    decided = spark.read.parquet(f"{folder}/revisits").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first_id")
    rows = _pages(pages)
    rows = rows.join(decided, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    again = F.col("first_id").isNotNull()
    url = F.regexp_replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    date = F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        date,
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id"), F.col("digest")))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    about = f"software: flowframe{CRLF}format: WARC File Format 1.1{CRLF}"
    info = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.lit("WARC-Type: warcinfo"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.uuid(), F.lit(">")), date, F.lit("Content-Type: application/warc-fields"), F.lit(f"Content-Length: {len(about)}"))
    info = F.concat(info, F.lit(CRLF + CRLF + about), F.lit(CRLF + CRLF))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its task, so of its file
    record = rows.select(F.concat(F.when(first, info).otherwise(""), head, F.lit(CRLF + CRLF), block).alias("value"))
    record.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(f"{folder}/archives")


class Archive:
    """Records of a stream of bytes that arrives in parts."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.wanted = 0, 0

    def feed(self, part: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, block) of the records that the part completes."""
        self.parts.append(part)
        self.size += len(part)
        while self.size and self.size >= self.wanted:
            data = b"".join(self.parts)
            start = len(data) - len(data.lstrip(b"\r\n"))  # between records, of which none begins with an empty line
            end = data.find(b"\r\n\r\n", start)
            if end < 0:
                self.parts, self.size = [data], len(data)
                return
            headers = {}
            for line in data[start:end].split(b"\r\n")[1:]:
                name, _, value = line.decode().partition(":")
                headers[name.strip().lower()] = value.strip()
            stop = end + 4 + int(headers["content-length"])
            if len(data) < stop + 4:
                self.parts, self.size, self.wanted = [data], len(data), stop + 4  # nothing is looked at again before that
                return
            if data[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("a record of an archive is not as long as it says")
            yield headers, data[end + 4 : stop]
            self.parts, self.size, self.wanted = [data[stop + 4 :]], len(data) - stop - 4, 0

    def close(self) -> None:
        if b"".join(self.parts).strip(b"\r\n"):
            raise ValueError("a record of an archive is cut short")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, record_type, refers_id, digest, payload_bytes, payload) of the archives; a revisit has no payload."""
    lines = spark.read.option("lineSep", CRLF + CRLF).option("recursiveFileLookup", "true").text(f"{folder}/archives").select(F.col("value").cast("binary").alias("data"))

    def run(batches):
        # a gzip file is one task's, and files end with whole records
        archive = Archive()
        for batch in batches:
            rows = []
            for data in batch.column("data"):
                for headers, block in archive.feed(data.as_py() + b"\r\n\r\n"):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    named = {k.strip().lower(): v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n"))}
                    rows.append(
                        {
                            "record_id": headers["warc-record-id"],
                            "record_type": kind,
                            "refers_id": headers.get("warc-refers-to"),
                            "digest": headers["warc-payload-digest"].removeprefix("sha1:"),
                            "payload_bytes": int(named[b"content-length"]),
                            "payload": payload if kind == "response" else None,
                        }
                    )
                if len(rows) >= 200:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)
        archive.close()

    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_id", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    return lines.mapInArrow(run, "record_id string, record_type string, refers_id string, digest string, payload_bytes bigint, payload binary")


def _page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+):", 1).try_cast("bigint")


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and reads back; a revisit's response is found by joining record ids, and a response's digest is taken anew."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    records = read(spark, folder)
    records = records.select("record_id", "record_type", "refers_id", "payload_bytes", F.coalesce(base32_sha1(F.col("payload")), F.col("digest")).alias("payload_digest"))
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("o_id")).distinct()
    revisit = records.where("record_type = 'revisit'").join(originals, F.col("refers_id") == F.col("o_id"), "left").withColumn("refers_to", _page_of(F.col("o_id")))
    response = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint"))
    columns = [_page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.select(*columns).unionAll(revisit.select(*columns))
