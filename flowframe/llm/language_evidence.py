"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from byte-trigram models, one a language, learned from labelled texts. The
language that markup declares is evidence with probabilities P(declared | language), and the address
gives a prior: a host's language shares, smoothed towards its domain's, those towards the address
suffix's, those towards the whole corpus's. All of these shares are grouped aggregates of the texts'
own posteriors over the whole corpus; a row's own share is taken out before it is judged. The text's
log-likelihood counts as that of TEXT_WEIGHT trigrams at most, as trigrams of a text aren't independent.

Defined results: null or empty texts leave the decision to the other evidence; a row without address
takes the corpus's shares as prior; a missing declaration is no evidence; ties go to the language that
sorts first; without labelled texts every language is null. Repeated rows are judged alike. Columns other
than those named are left out, so none can clash.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, cut, salted, table, text_or_empty

#: The fitting sample: texts of each language at most, and their length in code points. Every language that is labelled is learned.
SAMPLE_PER_LANGUAGE, SAMPLE_TEXT = 400, 20_000
BITS, TEXT_WEIGHT, SMOOTHING = 16, 100, 20.0
_HIDDEN = ("script", "style", "noscript", "template")
_OPENS = re.compile(rf"(?i)({'|'.join(_HIDDEN)})\b")
_CLOSES = {name: re.compile(rf"(?i)</{name}\s*>") for name in _HIDDEN}
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]+)")


def visible(page: str) -> str:
    """A page without tags, comments and what scripts and styles hold. Each search that finds nothing is made once, so the time is linear.

    A comment or script that never ends is only its own tag; a < without > is text.
    """
    out, at = [], 0
    missing = set()

    def end_of(name: str, find) -> int:
        if name in missing:
            return -1
        found = find()
        if found < 0:
            missing.add(name)
        return found

    def closing(pattern: re.Pattern, start: int) -> int:
        found = pattern.search(page, start)
        return found.end() if found else -1

    while (start := page.find("<", at)) >= 0:
        end = -1
        if page.startswith("<!--", start):
            end = end_of("-->", lambda: page.find("-->", start + 4))
            end = end + 3 if end >= 0 else -1
        elif opened := _OPENS.match(page, start + 1):
            name = opened[1].lower()
            end = end_of(name, lambda: closing(_CLOSES[name], opened.end()))
        if end < 0:
            end = end_of(">", lambda: page.find(">", start))
            if end < 0:
                break
            end += 1
        out += (page[at:start], " ")
        at = end
    return "".join((*out, page[at:]))


def declared(page: str) -> str | None:
    """The language that the page's first html tag names."""
    tag = _HTML.search(page)
    if not tag:
        return None
    end = page.find(">", tag.end())
    found = _LANG.search(page, tag.end(), end if end >= 0 else len(page))
    return found[1].lower() if found else None


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # float32, trigram x language


def _trigrams(data: bytes) -> np.ndarray:
    """Hashes of a text's byte trigrams."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    packed = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (packed * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def fit(docs: DataFrame, lang_col: str = "lang") -> Model:
    """From SAMPLE_PER_LANGUAGE texts of each label, those with the smallest hash of the id, out of rows whose crc32(doc_id) mod 5 is not 0."""
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_or_empty().alias("text"))
    labelled = labelled.where("doc_id is not null and lang is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    fits = F.length("text").between(3, SAMPLE_TEXT)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count_if(fits).alias("n")).collect()}
    named = sorted(sizes)
    counts = np.full((1 << BITS, len(named)), 0.5)
    if any(sizes.values()):
        # of a frequent language only ids with a small hash compete, some three times as many as are wanted: groups are small, whatever the table
        reach = [(name, min(1.0, (3 * SAMPLE_PER_LANGUAGE + 30) / n)) for name, n in sizes.items() if n]
        bound = F.broadcast(docs.sparkSession.createDataFrame(reach, "lang string, reach double"))
        place = (F.col("h").cast("double") + 2.0**63) / 2.0**64
        ids = labelled.where(fits).select("lang", "doc_id").withColumn("h", F.xxhash64("doc_id")).join(bound, "lang").where(place <= F.col("reach"))
        ranked = ids.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
        chosen = F.broadcast(ranked.where(F.col("nth") <= SAMPLE_PER_LANGUAGE).select(F.col("doc_id").alias("id"), F.col("lang").alias("of")))
        for row in labelled.where(fits).join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of"))).select("lang", "text").collect():
            counts[:, named.index(row["lang"])] += np.bincount(_trigrams(row["text"].encode()), minlength=1 << BITS)
    return Model(tuple(named), np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32))


def _evidence(model: Model, texts: list[bytes]) -> np.ndarray:
    """Log-likelihoods by language, text by text."""
    out = np.zeros((len(texts), len(model.languages)))
    for a, b in by_bytes(texts, 300_000):
        data = b"\0\0".join(texts[a:b])
        rows = model.table[_trigrams(data)]
        start = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts[a:b]])[:-1]])
        for i, t in enumerate(texts[a:b]):
            n = len(t) - 2
            if n > 0:
                out[a + i] = rows[start[i] : start[i] + n].sum(0, dtype=np.float64) * (min(n, TEXT_WEIGHT) / n)
    return out


def _address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix (the last)."""
    try:
        host = urlsplit(url).hostname if url else None
    except ValueError:
        host = None
    if not host:
        return None, None, None
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


_SCHEMA = "doc_id bigint, page_id bigint, host string, domain string, suffix string, declared string, evidence array<double>"


def _rows(model: Model, doc_ids, page_ids, addresses, stated, texts) -> pa.RecordBatch:
    evidence = _evidence(model, texts)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(doc_ids, pa.int64()),
            "page_id": pa.array(page_ids, pa.int64()),
            "host": pa.array([a[0] for a in addresses], pa.string()),
            "domain": pa.array([a[1] for a in addresses], pa.string()),
            "suffix": pa.array([a[2] for a in addresses], pa.string()),
            "declared": pa.array(stated, pa.string()),
            "evidence": pa.array(list(evidence), pa.list_(pa.float64())),
        }
    )


def page_evidence(pages: DataFrame, model: Model) -> DataFrame:
    """Evidence of web pages: visible text, declared language, address."""

    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids, urls, pages_ = (part.column(c).to_pylist() for c in ("page_id", "url", "html"))
                texts = [entities.unescape(visible(h)).encode("utf-8", "replace") for h in pages_]
                yield _rows(sent.value, [None] * len(ids), ids, [_address(u) for u in urls], [declared(h) for h in pages_], texts)

    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", text_or_empty("html").alias("html"))
    return slim.mapInArrow(run, _SCHEMA)


def document_evidence(docs: DataFrame, model: Model) -> DataFrame:
    """Evidence of plain documents: their text, and their source in place of a host."""

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids, sources, texts = (batch.column(c).to_pylist() for c in ("doc_id", "source", "data"))
            yield _rows(sent.value, ids, [None] * len(ids), [(s, s, "") if s else (None,) * 3 for s in sources], [None] * len(ids), texts)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().cast("binary").alias("data"))
    return slim.mapInArrow(run, _SCHEMA)


def _softmax(scores: Column) -> Column:
    weights = F.element_at(F.transform(F.array(F.array_max(scores)), lambda m: F.transform(scores, lambda x: F.exp(x - m))), 1)
    return F.element_at(F.transform(F.array(weights), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, b: a + b))), 1)


def fuse(evidence: DataFrame, model: Model) -> DataFrame:
    """(doc_id, page_id, lang, confidence, text_lang): all evidence put together."""
    k = len(model.languages)
    rows = cut(evidence.withColumn("own", _softmax(F.col("evidence"))))

    def shares(frame: DataFrame, *by: str) -> DataFrame:
        sums = frame.groupBy(*by).agg(*[F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(k)])
        return sums.select(*by, F.array(*[F.col(f"s{i}") for i in range(k)]).alias("own"))

    host = cut(shares(rows.where("host is not null"), "host", "domain", "suffix"))
    of_language = shares(rows.where("declared is not null"), "declared").withColumnRenamed("own", "of_declared")
    everywhere = rows.agg(*[F.coalesce(F.sum(F.col("own")[i]), F.lit(0.0)) for i in range(k)]).first()
    stated = rows.where("declared is not null").agg(*[F.coalesce(F.sum(F.col("own")[i]), F.lit(0.0)) for i in range(k)]).first()
    domain = shares(host, "domain", "suffix").withColumnRenamed("own", "of_domain")
    suffix = shares(host, "suffix").withColumnRenamed("own", "of_suffix")
    levels = host.withColumnRenamed("own", "of_host").join(domain, ["domain", "suffix"]).join(suffix, "suffix").select("host", "of_host", "of_domain", "of_suffix")
    # many rows have no host, or one of few: these are dealt out by their ids
    joined = salted(rows, levels, "host", "doc_id", "page_id", how="left")
    joined = salted(joined, of_language, "declared", "doc_id", "page_id", how="left")
    total, n_stated = float(sum(everywhere)), float(sum(stated))

    def prior(i: int) -> Column:
        own = F.col("own")[i]
        share = (F.lit(float(everywhere[i])) - own + 1.0) / (total - 1.0 + k)
        for level in ("of_suffix", "of_domain", "of_host"):
            sums = F.col(level)
            n = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
            share = F.when(sums.isNull(), share).otherwise((F.greatest(sums[i] - own, F.lit(0.0)) + SMOOTHING * share) / (F.greatest(n - 1.0, F.lit(0.0)) + SMOOTHING))
        return share

    def said(i: int) -> Column:
        """log P(declared | language i), the row itself left out."""
        sums, own = F.col("of_declared"), F.col("own")[i]
        usual = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b) / max(n_stated, 1.0)
        chance = (F.greatest(sums[i] - own, F.lit(0.0)) + usual) / (F.greatest(F.lit(float(stated[i])) - own, F.lit(0.0)) + 1.0)
        return F.when(sums.isNull(), 0.0).otherwise(F.log(chance))

    scores = F.array(*[F.col("evidence")[i] + F.log(prior(i)) + said(i) for i in range(k)])
    judged = joined.select("doc_id", "page_id", F.col("own"), scores.alias("scores")).withColumn("p", _softmax(F.col("scores")))
    names = F.array(*map(F.lit, model.languages))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return judged.select("doc_id", "page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"), best(F.col("own")).alias("text_lang"))


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and pages, each judged with what it offers."""
    model = fit(docs)
    evidence = document_evidence(docs, model).unionAll(page_evidence(pages, model))
    if not model.languages:
        return evidence.select("doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    return fuse(evidence, model)


def op5_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify(docs, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
