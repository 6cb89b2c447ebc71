"""Quality scores from compression: which of two dictionaries shortens a text more.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is compressed in
blocks with each; the difference of the two sizes, divided by the text's own size, is the evidence, and
the only one. (Divided by the size without a dictionary, endlessly repeated words, which shrink to almost
nothing, would have their chance differences blown up.) A logistic curve fitted on labelled texts that the
dictionaries have not seen turns it into a probability. Long texts are cut into blocks because a compressor
soon knows more from the text itself than from the dictionary; every block of the whole text counts.

Defined results: null and empty texts have evidence 0 and get the curve's value there; equal texts
have equal scores; without any label of a class every score is the share of good labels (0.5 if there
are no labels at all). Rows of `labels` with a null doc_id or quality teach nothing. Other columns stay as
they are: where one is called quality_score already, the score's name is lengthened by underscores (see
`score_name`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, text_or_empty

#: The fitting sample: texts of each class at most, and code points of a text that may be in it.
SAMPLE_PER_CLASS, SAMPLE_TEXT = 2000, 20_000
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 112_640, 1024, 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float | None  # none: no curve was fitted, every score is the same
    offset: float


class Sizes:
    """Compressed sizes of a text's blocks, with the good dictionary and the bad one."""

    def __init__(self, good: bytes, bad: bytes):
        self.tools = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)
        ]

    def evidence(self, data: bytes) -> float:
        """The normalised size difference."""
        if not data:
            return 0.0
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        good, bad = (sum(len(tool.compress(x)) for x in blocks) for tool in self.tools)
        return (bad - good) / len(data)


def _curve(x: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x * slope + offset, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge, on the standardised evidence."""
    mean, spread = x.mean(), max(x.std(), 1e-9)
    features = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    theta, ridge = np.zeros(2), 0.1 * np.eye(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        gradient = features.T @ (weight * (y - p)) - ridge @ theta
        step = np.linalg.solve((features * (weight * p * (1 - p))[:, None]).T @ features + ridge, gradient)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    slope = theta[0] / spread
    return float(slope), float(theta[1] - slope * mean)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod 5 is not 0.

    The sample is bounded: SAMPLE_PER_CLASS texts of each class, those with the smallest hash of the
    id among texts of up to SAMPLE_TEXT code points. Class shares come from all training labels.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        share = 0.5 if not total else float(min(max(next(iter(total)), 1e-6), 1 - 1e-6))
        return Model(b"", b"", None, float(np.log(share / (1 - share))))
    # more ids than are wanted, as some have long texts or none: a bound on what is broadcast and collected
    picked = [marks.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE_PER_CLASS) for q in (0, 1)]
    picked = picked[0].unionAll(picked[1]).select(F.col("doc_id").alias("__id"), "quality")
    slim = docs.select(F.col("doc_id").alias("__doc"), text_or_empty().alias("text")).where(f"length(text) between 1 and {SAMPLE_TEXT}")
    found = slim.join(F.broadcast(picked), F.col("__doc") == F.col("__id")).select("quality", F.xxhash64("__id").alias("h"), F.col("text"))
    kept = [found.where(f"quality = {q}").orderBy("h", "text").limit(SAMPLE_PER_CLASS) for q in (0, 1)]
    rows = kept[0].unionAll(kept[1]).collect()
    texts = {q: [r["text"].encode() for r in sorted(rows, key=lambda r: (r["h"], r["text"])) if r["quality"] == q] for q in (0, 1)}
    share = total[1] / (total[0] + total[1])
    if not texts[0] or not texts[1]:
        return Model(b"", b"", None, float(np.log(share / (1 - share))))
    # every third text calibrates, the others make the dictionaries
    held = {q: texts[q][::3] for q in texts}
    seen = {q: [x for i, x in enumerate(texts[q]) if i % 3] or texts[q] for q in texts}
    good, bad = (_dictionary(seen[q]) for q in (1, 0))
    sizes = Sizes(good, bad)
    x = np.array([sizes.evidence(t) for q in (1, 0) for t in held[q]])
    y = np.repeat([1.0, 0.0], [len(held[1]), len(held[0])])
    weight = np.repeat([share / len(held[1]), (1 - share) / len(held[0])], [len(held[1]), len(held[0])]) * len(x)
    return Model(good, bad, *_logistic(x, y, weight))


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to select from: the text itself serves
        return b"".join(texts)[-DICTIONARY_BYTES:]


def score_name(docs: DataFrame) -> str:
    """What the column of scores is called beside the columns of docs."""
    return free_name(docs, "quality_score")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column of scores, `score_name(docs)`, whatever other columns it has."""
    # a row at a time goes through the worker as text; ids and labels never reach it
    name = free_name(docs, "__quality_text")

    @F.pandas_udf("double")
    def scored(texts):
        if model.slope is None:
            return pd.Series(_curve(np.zeros(len(texts)), 0.0, model.offset))
        sizes = Sizes(model.good, model.bad)
        return pd.Series(_curve(np.array([sizes.evidence(x.encode()) for x in texts], float), model.slope, model.offset))

    return docs.withColumn(name, text_or_empty()).withColumn(score_name(docs), scored(F.col(name))).drop(name)


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
