"""Benchmark decontamination by greedy string tiling.

Texts are compared as words (runs of letters and digits, lower-cased). Documents meet benchmark items in a
join of shared seeds, hashes of SEED words; for each pair the longest common run of words that no earlier
tile covers is marked, again and again, until none of SEED words is left. Equal runs are found by running
Karp-Rabin hashes of the words. The share of an item's words that tiles cover doesn't depend on their order,
so a reordered passage counts like the original.

Both sides of the join are tables. A filter of FILTER_BITS bits at most keeps most seeds that no item has out
of it (a seed that passes by chance meets nothing), so of a document only words near possible seeds move.
Seeds are dealt to SALT parts each, as one may stand in a third of all documents. Pairs that can't reach the
coverage go before they are tiled: a tile of n words holds n - SEED + 1 seeds, so what is covered is at most
SEED times the places of shared seeds.

Defined results: null and empty texts are never contaminated; an item of fewer than SEED words has no
seed and matches nothing; items with a null id are left out; repeated item or document rows give the row of
the ids once, texts that share an id the best of their figures; of documents without an id each has rows of
its own; ties between equally long runs go to the earliest place in the item, then in the document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, by_bytes, row_key, table, text_or_empty, written

SEED, COVERAGE, SALT = 5, 0.5, 8
FILTER_BITS = (22, 27)  # least and most: 0.5 to 16 MB
_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = _U(pow(_BASE, -1, 1 << 64))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes that all workers share; Karp-Rabin needs the words as numbers."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], _U)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Running:
    """Karp-Rabin hashes, modulo 2^64 with an odd base, of all runs of any length, from sums over prefixes."""

    def __init__(self, values: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.full(len(values) + 1, _BACK)
            power[0] = 1
            power = np.cumprod(power, dtype=_U)
            self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * power[:-1], dtype=_U)])
            scale = np.full(len(values) + 1, _U(_BASE))
            scale[0] = 1
            self.scale = np.cumprod(scale, dtype=_U)

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[starts + size] - self.sums[starts]) * self.scale[starts]
            return h ^ (h >> _U(29))


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of `size` values."""
    return Running(values).at(np.arange(max(len(values) - size + 1, 0)), size)


def _open(free: np.ndarray, size: int) -> np.ndarray:
    """Places from which `size` free ones follow."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[size:] == taken[:-size])


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(item start, document start, words) of greedy tiles. item and doc are word hashes.

    The greatest length at which free runs of both are equal is found by halving; all tiles of that length are
    marked before a smaller one is sought. There are fewer lengths than twice the root of the item's words, so a
    round's cost, in proportion to the words, holds for periodic texts too.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    of_item, of_doc = Running(item), Running(doc)
    found: list[tuple[int, int, int]] = []

    def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j = _open(free_item, size), _open(free_doc, size)
        a, b = of_item.at(i, size), of_doc.at(j, size)
        common = np.intersect1d(a, b)
        keep_i, keep_j = np.isin(a, common), np.isin(b, common)
        return i[keep_i], a[keep_i], j[keep_j], b[keep_j]

    most = min(len(item), len(doc))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(shared(middle)[0]) else (low, middle - 1)
        size = low
        if size < least:
            break
        i, a, j, b = shared(size)
        waiting: dict[int, list[int]] = {}
        for place, h in zip(j[::-1].tolist(), b[::-1].tolist()):
            waiting.setdefault(h, []).append(place)  # the earliest stands last
        for start, h in zip(i.tolist(), a.tolist()):
            # tiles so far are as long at least, so one that meets a run covers one of its ends
            if not (free_item[start] and free_item[start + size - 1]):
                continue
            places = waiting[h]
            while places:
                place = places[-1]
                if free_doc[place] and free_doc[place + size - 1] and (item[start : start + size] == doc[place : place + size]).all():
                    free_item[start : start + size] = False
                    free_doc[place : place + size] = False
                    found.append((start, place, size))
                    break
                places.pop()
        most = size - 1
    return found


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, item_words, words, seeds, times) of each distinct item of SEED words or more. Written."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), text_or_empty().alias("text")).distinct()

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("item", "item_id", "item_words", "words", "seeds", "times")}
            for item, number, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text"))):
                words = word_hashes(words_of(text))
                if len(words) >= SEED:
                    seeds, times = np.unique(rolling(words, SEED).view(np.int64), return_counts=True)
                    for n, x in zip(out, (item, number, len(words), words.tobytes(), seeds, times)):
                        out[n].append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds)], list(out))

    schema = "item bigint, item_id bigint, item_words bigint, words binary, seeds array<bigint>, times array<bigint>"
    return written(rows.withColumn("item", F.xxhash64("item_id", "text")).mapInArrow(run, schema))


def touched(docs: DataFrame, bits: bytes) -> DataFrame:
    """(row, doc_id, seeds, runs) of documents that may share a seed with an item: the seeds, and the words they cover. Written.

    Runs of words stay apart by a zero, which no item has.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    slim = docs.select(row_key().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches):
        known = np.frombuffer(sent.value, np.uint8)
        mask = _U(8 * len(known) - 1)
        for part in (batch.slice(i, 1000) for batch in batches for i in range(0, batch.num_rows, 1000)):
            rows, ids, texts = (part.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            for a, b in by_bytes(texts, 1_000_000):
                words = [words_of(t) for t in texts[a:b]]
                count = np.array([len(w) for w in words])
                values = word_hashes([w for ws in words for w in ws])
                seeds = rolling(values, SEED)
                slot = (seeds & mask).astype(np.int64)
                hit = np.flatnonzero((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                stop = np.cumsum(count)
                owner = np.searchsorted(stop, hit, side="right")
                inside = hit + SEED <= stop[np.minimum(owner, len(stop) - 1)]
                hit, owner = hit[inside], owner[inside]
                out = []
                for d in np.unique(owner).tolist():
                    here = hit[owner == d]
                    near = np.zeros(count[d] + 2, np.int8)  # words that no seed covers are in no tile
                    for k in range(SEED):
                        near[here - (stop[d] - count[d]) + k + 1] = 1
                    edge = np.flatnonzero(np.diff(near))
                    doc = values[stop[d] - count[d] : stop[d]]
                    runs = [x for i, j in zip(edge[::2], edge[1::2]) for x in (doc[i:j], np.zeros(1, _U))]
                    out.append((rows[a + d], ids[a + d], np.unique(seeds[here]).view(np.int64), np.concatenate(runs).tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["row", "doc_id", "seeds", "runs"])

    return written(slim.mapInArrow(run, "row bigint, doc_id bigint, seeds array<bigint>, runs binary"))


def matched_rows(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(row, doc_id, item_id, item_words, covered, longest, coverage) of pairs whose tiles cover at least that share.

    row: `common.row_key` of the document, which rows without an id have too.
    """
    items = items_of(benchmark)
    seeds = items.select("item", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("item", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    near = touched(docs, bit_filter(seeds, "seed", FILTER_BITS))
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    asked = near.select("row", F.explode("seeds").alias("seed"), F.pmod("row", F.lit(SALT)).cast("int").alias("salt")).distinct()
    shared = asked.join(salted, ["seed", "salt"]).groupBy("row", "item").agg(F.sum("times").alias("places"))
    size = items.select("item", "item_id", "item_words", "words")
    pairs = written(shared.join(size.drop("words", "item_id"), "item").where(F.col("places") * SEED >= F.col("item_words") * coverage).select("row", "item"))
    both = pairs.join(near.select("row", "doc_id", "runs"), "row").join(size, "item")

    def run(batches):
        for batch in batches:
            out = []
            for item, doc in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
                marked = tiles(np.frombuffer(item, _U), np.frombuffer(doc, _U))
                out.append((sum(t[2] for t in marked), max((t[2] for t in marked), default=0)))
            columns = [batch.column(c) for c in ("row", "doc_id", "item_id", "item_words")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i] for x in out], pa.int64()) for i in range(2))], ["row", "doc_id", "item_id", "item_words", "covered", "longest"])

    tiled = both.select("row", "doc_id", "item_id", "item_words", "words", "runs").mapInArrow(run, "row bigint, doc_id bigint, item_id bigint, item_words bigint, covered bigint, longest bigint")
    return tiled.withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= coverage)


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered, longest, coverage): once for each document and item."""
    alone = F.when(F.col("doc_id").isNull(), F.col("row")).alias("__alone")
    best = matched_rows(docs, benchmark, coverage).groupBy("doc_id", "item_id", alone)
    return best.agg(*[F.max(c).alias(c) for c in ("item_words", "covered", "longest", "coverage")]).drop("__alone")


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
