"""Language-model scores by deleted interpolation of word n-grams.

P(w | h) = l2(b) c(h w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1): maximum-likelihood estimates of the word
bigram and of the word, and an equal share for each of the V known words and for what is unknown, mixed by the
bucket b of the context's frequency c(h) (0, then one bucket an octave). The weights are learned by
expectation-maximisation on held-out counts: one seventh of the training documents (remainder EM_FOLD) is
deleted from the counts, and its tokens, with the counts of the others, are the events. Over a vocabulary and
the unknown word the probabilities of any context sum to one: in bucket 0 l2 is zero.

All words and bigrams are counted, none is dropped or binned. Documents are packed into slices, rows of some
MB of compressed text, and written once. A slice asks for its distinct words and bigrams (64-bit hashes, sorted,
dealt to ranges); each range adds up what its slices hold, and answers every slice with the counts in the order
asked, so that no hash travels back and a slice's tokens never do. A frequent word is one entry a slice. The
events of the EM are grouped by their exact counts in a written table, and each step is one aggregation of it.

Defined results: null and empty texts are one end token; rows with a null doc_id teach nothing and are
not held out; repeated rows count as often as they occur and get equal scores; without training tokens
every weight is on the unknown, whose probability is 1 / (V + 1) = 1, so every score is 0; without events
(no document in the EM's part) every estimate that a context has weighs the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, shuffle_partitions, table, text_or_empty, written

BUCKETS, STEPS, CLOSE = 48, 40, 1e-5
FOLDS, TEST_FOLD, EM_FOLD = 7, 2, 3
#: Bytes of text: of a slice, of one piece of tokens inside it, and of what one range of keys answers for.
SLICE, PIECE, RANGE = 4_000_000, 1_000_000, 24_000_000
TRAIN, DELETED, TEST, NO_ID = range(4)
_END, _START = (xxhash.xxh64_intdigest(x, 7) for x in (b"end of text ", b"start of text "))
_U = np.uint64


def _shut(values: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, lowest bytes first, compressed: what small numbers leave empty costs nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


class Tokens:
    """All tokens of some texts, ends among them, under the keys of their words and bigrams.

    keys: sorted, distinct; the last bit is 0 for words, 1 for bigrams. times: how often each occurs. word, pair,
    context: for each token the places in keys of its word, its bigram and the word before it (of a text's first
    token the end, which is as frequent as the start). owner: the token's text.
    """

    def __init__(self, texts: list[bytes]):
        digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
        for a, b in by_bytes(texts, PIECE):
            words = [t.lower().split() for t in texts[a:b]]
            sizes += [len(w) + 1 for w in words]
            hashes.append(np.array([h for ws in words for h in (*map(digest, ws), _END)], _U))
        size = np.array(sizes, np.int64)
        word = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        first = np.cumsum(size) - size
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[first] = _START
        with np.errstate(over="ignore"):
            pair = (before * _U(0x9E3779B97F4A7C15) + (word ^ (word >> _U(31)))) * _U(0xD6E8FEB86659FD93)
            pair ^= pair >> _U(32)
        both = np.concatenate([word & ~_U(1), pair | _U(1)])
        self.keys, place, self.times = np.unique(both, return_inverse=True, return_counts=True)
        self.word, self.pair = place[: len(word)], place[len(word) :]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        if len(word):
            self.context[first] = self.word[size[0] - 1]  # every text has an end
        self.size, self.owner = size, np.repeat(np.arange(len(texts)), size)


def estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, v: int) -> np.ndarray:
    """Three columns: the maximum-likelihood estimates from counts, and the share of every word, known or not."""
    return np.stack([pair / np.maximum(context, 1), word / max(n, 1), np.full(len(word), 1 / (v + 1))], 1)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket an octave."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def packed(docs: DataFrame) -> DataFrame:
    """(slice, role, ids, bytes, texts): rows of documents of one role. Written: a slice is the same whenever it is read."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(-1))
    role = F.when(fold == -1, NO_ID).when(fold == TEST_FOLD, TEST).when(fold == EM_FOLD, DELETED).otherwise(TRAIN)
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("bigint").alias("doc_id"), role.cast("int").alias("role"), text_or_empty().cast("binary").alias("data"))

    def run(batches):
        held = {r: ([], [], []) for r in range(4)}
        size = [0] * 4

        def close(r: int) -> pa.RecordBatch:
            numbers, ids, texts = held[r]
            held[r], size[r] = ([], [], []), 0
            lengths = np.array([len(t) for t in texts], np.int64)
            blob = zstandard.ZstdCompressor(level=3).compress(lengths.tobytes() + b"".join(texts))
            return pa.RecordBatch.from_pydict({"slice": pa.array([numbers[0]], pa.int64()), "role": pa.array([r], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int64())), "bytes": pa.array([int(lengths.sum())], pa.int64()), "texts": pa.array([blob], pa.binary())})

        for part in (batch.slice(i, 1000) for batch in batches for i in range(0, batch.num_rows, 1000)):
            for number, doc_id, r, text in zip(*(part.column(c).to_pylist() for c in ("number", "doc_id", "role", "data"))):
                if held[r][0] and size[r] + len(text) > SLICE:
                    yield close(r)
                for x, value in zip(held[r], (number, doc_id, text)):
                    x.append(value)
                size[r] += len(text) + 8
        for r in range(4):
            if held[r][0]:
                yield close(r)

    return written(rows.mapInArrow(run, "slice bigint, role int, ids array<bigint>, bytes bigint, texts binary"))


def _texts(blob: bytes, n: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    stop = np.cumsum(np.frombuffer(data, np.int64, n)) + 8 * n
    return [data[a:b] for a, b in zip([8 * n, *stop.tolist()], stop.tolist())]


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range's keys start among sorted keys, and the end."""
    of = ((keys >> _U(32)) * _U(ranges)) >> _U(32)
    return np.searchsorted(of, np.arange(ranges + 1, dtype=_U))


_ANSWER = "slice bigint, role int, place int, counts binary, rest binary, n bigint, v bigint, n_left bigint, v_left bigint"


def counts(slices: DataFrame, ranges: int) -> DataFrame:
    """Answers to every slice: counts of its keys of one range, and for a deleted slice what is left of them without the deleted ones.

    A range also states its share of N and V, and of both without what is deleted, in a row without a slice. Written.
    """

    def ask(batches):
        for batch in batches:
            for number, role, ids, blob in zip(*(batch.column(c) for c in ("slice", "role", "ids", "texts"))):
                tokens = Tokens(_texts(blob.as_py(), len(ids)))
                at = _ranges(tokens.keys, ranges)
                used = np.flatnonzero(np.diff(at)).tolist()
                steps = [np.diff(tokens.keys[at[i] : at[i + 1]], prepend=_U(0)) for i in used]
                k = len(used)
                yield pa.RecordBatch.from_pydict(
                    {
                        "place": pa.array(used, pa.int32()),
                        "slice": pa.array([number.as_py()] * k, pa.int64()),
                        "role": pa.array([role.as_py()] * k, pa.int32()),
                        "keys": pa.array([_shut(x) for x in steps], pa.binary()),
                        "times": pa.array([_shut(tokens.times[at[i] : at[i + 1]]) for i in used], pa.binary()),
                    }
                )

    def answer(group: pa.Table) -> pa.Table:
        place, numbers, roles = group.column("place")[0].as_py(), group.column("slice"), group.column("role").to_pylist()
        keys = [np.cumsum(_opened(x.as_py()), dtype=_U) for x in group.column("keys")]
        stop = np.cumsum([len(x) for x in keys])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        total, deleted = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        for role, times, b in zip(roles, group.column("times"), stop.tolist()):
            if role in (TRAIN, DELETED):
                here = _opened(times.as_py()).astype(np.int64)
                total[at[b - len(here) : b]] += here  # a slice has each key once
                if role == DELETED:
                    deleted[at[b - len(here) : b]] += here
        left, words = total - deleted, (found & _U(1)) == 0
        own = [at[a:b] for a, b in zip([0, *stop.tolist()], stop.tolist())]
        sums = [int(x[words].sum()) if i % 2 == 0 else int((x[words] > 0).sum()) for i, x in enumerate((total, total, left, left))]
        k = len(roles)
        return pa.table(
            {
                "slice": pa.concat_arrays([numbers.combine_chunks(), pa.nulls(1, pa.int64())]),
                "role": pa.array([*roles, None], pa.int32()),
                "place": pa.array([place] * (k + 1), pa.int32()),
                "counts": pa.array([*(_shut(total[x]) for x in own), None], pa.binary()),
                "rest": pa.array([*(_shut(left[x]) if r == DELETED else None for x, r in zip(own, roles)), None], pa.binary()),
                **{name: pa.array([None] * k + [x], pa.int64()) for name, x in zip(("n", "v", "n_left", "v_left"), sums)},
            }
        )

    asked = slices.mapInArrow(ask, "place int, slice bigint, role int, keys binary, times binary")
    return written(asked.groupBy("place").applyInArrow(answer, _ANSWER))


def _answered(answers: pa.Table, column: str) -> np.ndarray:
    """A slice's counts in the order of its keys."""
    order = np.argsort(answers.column("place").to_numpy())
    every = answers.column(column)
    return np.concatenate([_opened(every[i].as_py()) for i in order.tolist()]).astype(np.int64)


def events(slices: DataFrame, answers: DataFrame) -> DataFrame:
    """(bucket, pair, context, word, times): deleted tokens by the exact counts of what is left. Written.

    Where the bigram is unknown the context's own count has no part in the estimate, only its bucket has.
    """

    def run(piece: pa.Table, said: pa.Table) -> pa.Table:
        parts = []
        for ids, blob in zip(piece.column("ids"), piece.column("texts")):
            tokens, c = Tokens(_texts(blob.as_py(), len(ids))), _answered(said, "rest")
            pair, context, word = c[tokens.pair], c[tokens.context], c[tokens.word]
            parts.append(np.stack([bucket_of(context), pair, np.where(pair > 0, context, 0), word]))
        rows = np.concatenate(parts, 1) if parts else np.zeros((4, 0), np.int64)
        rows = rows[:, np.lexsort(rows)]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, rows.shape[1]), bool), (rows[:, 1:] != rows[:, :-1]).any(0)]))
        times = np.diff(np.append(first, rows.shape[1]))
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("bucket", "pair", "context", "word", "times"), (*rows[:, first], times))})

    schema = "bucket bigint, pair bigint, context bigint, word bigint, times bigint"
    mine = slices.where(F.col("role") == DELETED).groupBy("slice").cogroup(answers.where(F.col("role") == DELETED).groupBy("slice")).applyInArrow(run, schema)
    return written(mine.groupBy("bucket", "pair", "context", "word").agg(F.sum("times").alias("times")))


def weights(found: DataFrame, n: int, v: int) -> np.ndarray:
    """BUCKETS x 3 mixture weights by expectation-maximisation. n and v are those without the deleted part."""
    mixture = np.full((BUCKETS, 3), 1 / 3)
    mixture[0] = 0, 0.5, 0.5
    if not n:
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    shares = (F.col("pair") / F.greatest("context", F.lit(1)), F.col("word") / F.lit(float(n)), F.lit(1 / (v + 1)))
    for _ in range(STEPS):
        held = [F.element_at(F.array(*map(F.lit, mixture[:, i].tolist())), (F.col("bucket") + 1).cast("int")) * x for i, x in enumerate(shares)]
        parted = found.select("bucket", "times", *[h.alias(f"p{i}") for i, h in enumerate(held)]).withColumn("all", F.col("p0") + F.col("p1") + F.col("p2"))
        sums = parted.groupBy("bucket").agg(*[F.sum(F.col("times") * F.col(f"p{i}") / F.col("all")).alias(f"s{i}") for i in range(3)]).collect()
        total = np.zeros((BUCKETS, 3))
        for r in sums:
            total[r["bucket"]] = r["s0"], r["s1"], r["s2"]
        new = mixed(total)
        moved, mixture = np.abs(new - mixture).max(), new
        if moved < CLOSE:
            break
    return mixture


def mixed(total: np.ndarray) -> np.ndarray:
    """Weights from what each estimate has earned in each bucket; buckets with few events lean on the others, by three events' worth."""
    everywhere = total.sum(0) + 1e-3
    total = total + 3 * everywhere / everywhere.sum()
    total[0, 0] = 0.0  # an unknown context has no bigram
    return total / total.sum(1, keepdims=True)


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_seen_elsewhere bigint"


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_seen_elsewhere) of each row.

    n_seen_elsewhere: tokens whose bigram the training documents have outside this one, too.
    """
    slices = packed(docs)
    whole = slices.agg(F.sum("bytes")).first()[0] or 0
    answers = counts(slices, max(shuffle_partitions(docs.sparkSession), -(-int(whole) // RANGE)))
    n, v, n_left, v_left = (int(x or 0) for x in answers.agg(*[F.sum(c) for c in ("n", "v", "n_left", "v_left")]).first())
    mixture = weights(events(slices, answers), n_left, v_left) if n else weights(slices, 0, 0)

    def run(piece: pa.Table, said: pa.Table) -> pa.Table:
        out = []
        for role, ids, blob in zip(piece.column("role").to_pylist(), piece.column("ids"), piece.column("texts")):
            tokens, c = Tokens(_texts(blob.as_py(), len(ids))), _answered(said, "counts")
            k, owner = len(ids), tokens.owner
            word, context, pair = c[tokens.word], c[tokens.context], c[tokens.pair]
            chance = (mixture[bucket_of(context)] * estimates(pair, context, word, n, v)).sum(1)
            per = lambda x: np.bincount(owner, x, minlength=k)
            # of a training document's own bigrams all occurrences but its own are elsewhere
            at, mine, times = np.unique(owner * len(tokens.keys) + tokens.pair, return_inverse=True, return_counts=True)
            elsewhere = pair - (times[mine] if role in (TRAIN, DELETED) else 0) > 0
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids.as_py(), pa.int64()),
                        "held_out": pa.array([role == TEST] * k, pa.bool_()),
                        "n_tokens": pa.array(tokens.size, pa.int64()),
                        "n_known": pa.array(per(word > 0).astype(np.int64)),
                        "train_tokens": pa.array(np.full(k, n), pa.int64()),
                        "base_score": pa.array(per(np.log10((word + 1) / (n + v + 1)))),
                        "score": pa.array(per(np.log10(chance))),
                        "n_seen_elsewhere": pa.array(per(elsewhere).astype(np.int64)),
                    }
                )
            )
        return pa.concat_tables(out) if out else _empty

    _empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64()), ("n_seen_elsewhere", pa.int64())]).empty_table()
    return slices.groupBy("slice").cogroup(answers.where("slice is not null").groupBy("slice")).applyInArrow(run, _SCORED)


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
