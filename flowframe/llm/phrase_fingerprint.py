"""Document fingerprints from locally consistent parsing.

A text's bytes are parsed into phrases by deterministic coin tossing: equal neighbours are collapsed,
each symbol is labelled by the lowest bit in which it differs from its left neighbour (and that bit),
labels are shortened the same way until they are below 6, and local maxima of the labels start phrases.
A phrase is named by a hash of its symbols, the names are parsed again, and so on. A boundary depends on
a few symbols around it, so equal substrings have equal phrases inside wherever they stand. The names
of levels FIRST_LEVEL to LAST_LEVEL (phrases of about 10 to 300 bytes) fill a one-permutation MinHash of
BINS bins; the likeness of two fingerprints is the share of equal bins among those either text fills.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, alike (1) only to
another empty one (0 to all others); documents are ordered by descending doc_id, rows that share an id
by text, a null id stands last; after the last row comes the first again, and a lone row follows itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, shuffle_partitions, table, text_or_empty

FIRST_LEVEL, LAST_LEVEL, BINS = 2, 5, 64
_SLICE = 400_000
_EMPTY = 0xFFFF
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


with np.errstate(over="ignore"):
    _BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    _PLACE = _mix(np.arange(1000, 1064, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _toss(label: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the lowest differing bit's number, plus that bit of the label."""
    x = label ^ before
    k = np.bitwise_count((x & (~x + label.dtype.type(1))) - label.dtype.type(1))
    return 2 * k + ((label >> k.astype(label.dtype)) & label.dtype.type(1)).astype(np.uint8)


#: For labels below 128: the next label at [label * 128 + label before].
_NEXT = _toss(np.repeat(np.arange(128, dtype=np.uint8), 128), np.tile(np.arange(128, dtype=np.uint8), 128))
#: The first label of two neighbouring bytes.
_FIRST = _toss(np.repeat(np.arange(256, dtype=np.uint8), 256), np.tile(np.arange(256, dtype=np.uint8), 256))


def _starts(label: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where phrases start. heads: first symbol of each text."""
    for _ in range(3):
        out = np.empty_like(label)
        out[1:] = _NEXT[label[1:].astype(np.uint16) * np.uint16(128) + label[:-1]]
        out[heads] = label[heads] & 1
        label = out
    peak = np.zeros(len(label), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[heads - 1] = False  # a text's last symbol has no right neighbour
    after = heads + 1
    peak[after[after < len(peak)]] = False  # no phrase of one symbol in front
    peak[heads] = True
    return np.flatnonzero(peak)


def _collapse(symbols: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal symbols become one: (first symbols' places, run lengths, heads among them)."""
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[heads] = True
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(symbols))), np.searchsorted(at, heads)


def _name(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    place = np.arange(len(names)) - np.repeat(starts, np.diff(np.append(starts, len(names))))
    return _mix(np.add.reduceat(names * _PLACE[place & 63], starts))


def sketches(texts: list[bytes]) -> np.ndarray:
    """BINS values of 16 bits for each text; 65535 marks an empty bin."""
    out = np.full((len(texts), BINS), _EMPTY, np.uint16)
    full = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(full):
        return out
    sizes = np.array([len(texts[i]) for i in full])
    data = np.frombuffer(b"".join(texts), np.uint8)
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    with np.errstate(over="ignore"):
        for level in range(1, LAST_LEVEL + 1):
            at, runs, heads = _collapse(data if level == 1 else names, heads)
            if level == 1:
                byte = data[at]
                names = _BYTE[byte]
                label = np.empty(len(byte), np.uint8)
                label[1:] = _FIRST[byte[1:].astype(np.uint16) * np.uint16(256) + byte[:-1]]
                label[heads] = byte[heads] & 1
            else:
                names = names[at]
                label = np.empty(len(names), np.uint8)
                label[1:] = _toss(names[1:], names[:-1])
                label[heads] = (names[heads] & _U(1)).astype(np.uint8)
            long = runs > 1
            if long.any():
                names[long] = _mix(names[long] + runs[long].astype(_U) * _U(0xA0761D6478BD642F))
            starts = _starts(label, heads)
            names = _name(names, starts)
            heads = np.searchsorted(starts, heads)
            if level >= FIRST_LEVEL:
                own = _mix(names + _U(level))
                owner = full[np.repeat(np.arange(len(full)), np.diff(np.append(heads, len(names))))]
                slot = owner * BINS + (own >> _U(58)).astype(np.int64)
                value = np.minimum((own >> _U(42)) & _U(0xFFFF), _U(_EMPTY - 1)).astype(np.uint16)
                np.minimum.at(out.reshape(-1), slot, value)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of sketches, pairwise."""
    used = (a != _EMPTY) | (b != _EMPTY)
    same = (a == b) & used
    return np.where(used.any(1), same.sum(1) / np.maximum(used.sum(1), 1), 1.0)


def as_text(sketch: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sketch]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row; no shuffle."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches):
        for batch in batches:
            texts = [x.encode() for x in batch.column("text").to_pylist()]
            found = [f for a, b in by_bytes(texts, _SLICE) for f in as_text(sketches(texts[a:b]))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(found, pa.string())})

    return slim.mapInArrow(run, "doc_id bigint, fingerprint string")


_LAST = -(2**63)


def with_followers(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, ordinal, doc_id, text): ranges of ids, each closed by a ghost of the row that follows it.

    Bucket borders are quantiles of the ids alone; texts are shuffled once.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    slim = slim.withColumn("ordinal", F.coalesce("doc_id", F.lit(_LAST)))
    ids = slim.select(F.col("ordinal").cast("double").alias("place"))
    wanted = 8 * parts
    borders = sorted(set(ids.approxQuantile("place", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted))))
    splits = [float("-inf"), *borders, float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="place", outputCol="range")

    def bucketed(frame: DataFrame) -> DataFrame:
        return ranged.transform(frame.withColumn("place", F.col("ordinal").cast("double"))).withColumn("bucket", F.col("range").cast("int")).drop("place", "range")

    # one row for each bucket: at most 8 times the number of shuffle partitions
    heads = sorted((r["bucket"], r["head"]) for r in bucketed(slim.select("ordinal")).groupBy("bucket").agg(F.max("ordinal").alias("head")).collect())
    follower = [(heads[i - 1][1], heads[i][0]) for i in range(len(heads))]  # the head of the bucket below closes this one; the lowest is closed by the highest
    ghosts = spark.createDataFrame(follower, "head bigint, closes int")
    rows = bucketed(slim).join(F.broadcast(ghosts), F.col("ordinal") == F.col("head"), "left")
    own = F.struct(F.col("bucket"), F.lit(0).alias("ghost"))
    both = F.when(F.col("closes").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("closes").alias("bucket"), F.lit(1).alias("ghost"))))
    placed = rows.select(F.explode(both).alias("at"), "ordinal", "doc_id", "text").select("at.bucket", "at.ghost", "ordinal", "doc_id", "text")
    return placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", F.desc("ordinal"), "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(rows: list[tuple], sketch: np.ndarray) -> pa.RecordBatch:
        """rows: (bucket, ghost, doc_id, text). All but the last are compared with the next in their bucket."""
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        edited = []
        for i in pairs:
            text, half = rows[i][3], len(rows[i][3]) // 2
            edited.append((text[: len(text) - half] + rows[i + 1][3][:half]).encode())
        other = sketches(edited)
        at = np.array(pairs, np.int64)
        columns = (
            pa.array([rows[i][2] for i in pairs], pa.int64()),
            pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array(as_text(sketch[at]), pa.string()),
            pa.array(as_text(other), pa.string()),
            pa.array(likeness(sketch[at], other), pa.float64()),
            pa.array(likeness(sketch[at], sketch[at + 1]), pa.float64()),
        )
        return pa.RecordBatch.from_arrays(list(columns), names)

    def run(batches):
        last, last_sketch = [], np.zeros((0, BINS), np.uint16)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text")]
            for a, b in by_bytes(columns[3], _SLICE):
                fresh = list(zip(*(c[a:b] for c in columns)))
                rows, sketch = last + fresh, np.concatenate([last_sketch, sketches([r[3].encode() for r in fresh])])
                yield compare(rows, sketch)
                last, last_sketch = rows[-1:], sketch[-1:]

    return with_followers(docs).select("bucket", "ghost", "doc_id", "text").mapInArrow(run, schema)


def op2_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
