"""What the second round of findings found missing."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from flowframe.llm import near_copies


def test_chance_meetings_make_no_large_component(spark, monkeypatch):
    """unrelated texts that share rare shingles were tied together, text by text, and every one was then sent to every block."""
    chance = random.Random(5)
    lines = [" ".join(chance.choices([f"w{i}" for i in range(3000)], k=6)) for _ in range(60)]
    rows = [(i, " ".join(x for k in range(8) for x in (chance.choice(lines), *(f"u{i}v{k}x{j}" for j in range(size // 8))))) for i, size in ((i, chance.choice([40, 200, 400])) for i in range(600))]
    rows += [(1000 + i, rows[i][1] + " the end") for i in range(0, 600, 20)]
    seen = []
    own = near_copies._verified_groups
    monkeypatch.setattr(near_copies, "_verified_groups", lambda texts, *a: seen.append(texts.count()) or own(texts, *a))
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in found if not r.stays} == {i for i, _ in rows[600:] if len(rows[i - 1000][1].split()) > 40} and seen[0] <= 100


def test_block_pairs_stay_under_twice_the_texts(spark, monkeypatch):
    """a component of n blocks had n copies of its texts on disk at once. Every two texts still meet."""
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", 1000)
    rows = [(7, i, b"x" * 100) for i in range(120)] + [(9, 1000 + i, b"y" * 10) for i in range(5)]
    texts = spark.createDataFrame(rows, "root bigint, node bigint, data binary")
    met, most = set(), 0
    for part in near_copies._block_pairs(texts):
        held = part.groupBy("root", "low", "high").agg(F.collect_list("node").alias("nodes"), F.sum(F.octet_length("data")).alias("bytes")).collect()
        most = max(most, sum(r.bytes for r in held))
        met |= {(a, b) for r in held for a in r.nodes for b in r.nodes if a < b}
        assert all(max(Counter(r.nodes).values()) == 1 for r in held)
    assert met == {(a, b) for g in (range(120), range(1000, 1005)) for a in g for b in g if a < b}
    assert most < 3 * sum(len(r[2]) for r in rows)


def test_filters_of_candidates_lose_no_link():
    """All pairs of a key that are alike pass the sizes, places and parities (SimHash is judged above WIDE only)."""
    chance = np.random.default_rng(3)
    sets = []
    for size in (1, 5, 9, 20, 33, 50, 79, 80, 99, 300):
        for _ in range(12):
            base = chance.integers(-(1 << 63), (1 << 63) - 1, size)
            for drop in range(6):
                keep = base[: size - drop * size // 30] if drop % 2 else base
                sets.append(np.unique(np.concatenate([keep, chance.integers(-(1 << 63), (1 << 63) - 1, drop * size // 50)])))
    none = np.zeros(0, np.int64)
    places = [{int(x): k for k, x in enumerate(near_copies.prefix(s, none, none, 0.8))} for s in sets]
    fp = np.array([near_copies.simhash_of(s.view(np.uint64)) for s in sets], np.int64).view(np.uint64)
    more = np.array([near_copies.second_word(s) for s in sets], np.int64).view(np.uint64)
    pivots = np.bitwise_count(fp[:, None] ^ near_copies.PIVOTS[None, :]).astype(np.int8)
    alike = passed = 0
    for i in range(len(sets)):
        for j in range(i + 1, min(i + 6, len(sets))):
            if near_copies.alike(sets[i], sets[j], 0.8):
                alike += 1
                shared = min(places[i].keys() & places[j].keys())
                at = np.array([places[i][shared], places[j][shared]])
                held = {"size": np.array([len(sets[i]), len(sets[j])]), "at": at, "fp": fp[[i, j]], "more": more[[i, j]], "pivots": pivots[[i, j]]}
                passed += len(near_copies._passing(np.array([0]), np.array([1]), held, 0.8, near_copies.BITS_APART))
    assert alike == passed > 500


def test_workers_of_the_last_stage_get_small_batches(spark, monkeypatch):
    """pipeline: batches of 10,000 texts, the session's, brought executors over 3000 MB."""
    import corpus_pipeline
    from flowframe.llm import common

    def sizes(docs, model):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint")

    monkeypatch.setattr(common, "BATCH_ROWS", 7)
    monkeypatch.setattr(corpus_pipeline.sentencepiece_codec, "tokenized", sizes)
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [r.n for r in corpus_pipeline.encode(spark, spark.range(100).selectExpr("id doc_id", "'a text' text"), "").collect()]
    assert sum(found) == 100 and max(found) <= 7 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == own


def test_last_stage_writes_small_row_groups(spark):
    """row groups of 128 MB, read again with their lists, overran the heap of executors."""
    import corpus_pipeline

    chance = random.Random(9)
    words = [f"w{chance.randrange(10**6)}" for _ in range(20_000)]
    rows = [(i, " ".join(chance.choices(words, k=600))) for i in range(3000)]
    found = corpus_pipeline.encode(spark, spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), "")
    groups = []
    for path in found.inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        groups += [meta.row_group(i) for i in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 3000 and max(g.total_byte_size for g in groups) < 12 << 20 < sum(g.total_byte_size for g in groups)
    assert {(r.doc_id, r.decoded) for r in found.select("doc_id", "decoded").collect()} == set(rows)


class Docs:
    """A frame whose mapInArrow gives the function back."""

    columns, schema = ["doc_id", "text"], StructType().add("doc_id", LongType()).add("text", StringType())
    mapInArrow = staticmethod(lambda run, schema: run)


def test_long_texts_leave_the_last_stage_in_slices_by_length():
    """200 long texts made one batch of some 100 MB."""
    from flowframe.llm import sentencepiece_codec as codec

    texts = ["many words here " * 2000, None, "", "few words"] * 50
    run = codec.tokenized(Docs, codec.default_model())
    found = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})])))
    rows = pa.Table.from_batches(found)
    assert rows["doc_id"].to_pylist() == list(range(200)) and rows["text"].to_pylist() == texts
    assert rows["decoded"].to_pylist() == [x or "" for x in texts]
    assert len(found) > 1 and all(b.num_rows == 1 or sum(len(x or "") for x in b["text"].to_pylist()) <= codec.SLICE for b in found)


def test_workers_of_the_last_stage_remember_few_cuts():
    """a worker remembered up to 300,000 cuts, some 100 MB, beside an executor close to its limit."""
    from flowframe.llm import sentencepiece_codec as codec

    model, held, found = codec.default_model(), [], []
    texts = [" ".join(f"{i:x}q{k}" for k in range(20_000)) for i in range(12)] * 2
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(24)), "text": texts})
    for part in codec.tokenized(Docs, model)(iter([batch])):
        held.append(len(codec.codec(model).ids_of))
        found += part["decoded"].to_pylist()
    assert found == texts and max(held) <= codec.REMEMBERED + codec.SLICE // 4
