"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a string of SPAN bytes that covers it also starts earlier in the corpus. Two facts
keep the suffix arrays small and lose nothing. A whole text that an earlier document has too is wholly
repeated if it has SPAN bytes, and what it repeats, the earlier document repeats, so it takes no further
part. And every string of SPAN bytes holds an anchor, the GRAM-byte string whose hash is the least in it,
picked alike wherever the string stands, with REACH bytes more before it or behind it: strings whose
anchors occur once so extended are unique. (Anchors alone come again by chance, and the more so the larger
the corpus.)

Shards are groups of repeated anchors with the text around each of their places, in pieces of RUN strings at
most. A shard's suffixes are sorted by prefix doubling after Larsson and Sadakane: they start ordered by STEP bytes,
and each round sorts only groups that are still tied, by the rank of what follows, until none is; pieces end in
symbols of their own, so no tie is longer than a piece. Common prefixes of neighbours come from Kasai's rule,
that a suffix shares at least one byte less than the one before it in the text: only where the bytes in front
differ are bytes compared. Neighbours of SPAN common bytes or more are the same string, and each string is judged
in the shard of its own anchor. Anchors with very many places are split among shards. The shards of a split
anchor each send their distinct strings in order, with the first place of each, and these arrays are merged one
by one by binary search, so that one place in the corpus stays the first. (Only there do shards have strings in
common: a binary search of every shard in every other would grow with the square of the shards.)

Defined results: a null text counts as empty; texts of fewer than SPAN bytes keep all; rows equal in
doc_id and text are one document, and get the same result; rows that share a doc_id but not the text
are ordered by a hash of the text; a null doc_id stands first.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, by_bytes, cut, shuffle_partitions, table, text_or_empty, written

SPAN, GRAM = 100, 36
_WINDOW = SPAN - GRAM + 1
REACH = _WINDOW // 2  # of what a string has beside its anchor, one side holds half
_SLICE = 1_500_000
_SHARD = 1_500_000  # bytes of context that one suffix array takes in
HOT = 2000  # places of an anchor that stay together, at least
RUN = 2048  # strings of a piece of text at most
STEP = 7  # bytes that suffixes are first ordered by
SLOTS = 256  # parts that the strings of a split anchor are merged in
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_PREFIX = 24  # bits of its anchor's hash that a key starts with


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, by doubling: a string's hash is made of two shorter ones'."""
    with np.errstate(over="ignore"):
        x = (data.astype(_U) + _U(1)) * _BASE
        size, made = 1, {1: x}
        while 2 * size <= GRAM:
            x = x[:-size] * _U(0xD6E8FEB86659FD93 + 2 * size) + (x[size:] ^ (x[size:] >> _U(31)))
            size *= 2
            made[size] = x
        rest = GRAM - size
        if rest:  # the last `size` bytes overlap the first
            x = x[:-rest] * _U(0xA0761D6478BD642F) + (x[rest:] ^ (x[rest:] >> _U(29)))
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """The minimum or maximum of every `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values = least(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return least(values[: len(values) - rest], values[rest:]) if rest else values


def _sided(h: np.ndarray, place: np.ndarray, other: np.ndarray, side: int) -> np.ndarray:
    """Keys of anchors with their neighbours on one side: the first _PREFIX bits are the anchor's, the rest mixed."""
    with np.errstate(over="ignore"):
        k = (h[place] * _U(0xD6E8FEB86659FD93) + (h[other] ^ (h[other] >> _U(31))) + _U(side)) * _BASE
    low = _U((1 << (64 - _PREFIX)) - 1)
    return (h[place] & ~low) | ((k ^ (k >> _U(32))) & low)


def anchors(texts: list[bytes]):
    """Three tables over texts of SPAN bytes or more.

    Anchors: (place, hash) of every place that is the least of some SPAN-byte string, places counted through all
    texts. Keys: (anchor's number, key) of each side on which an anchor has REACH bytes. Runs: (text, first,
    last, hash, place of first) of neighbouring strings with the same least hash.
    """
    h = _gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    least = _sliding(h, _WINDOW, np.minimum)
    stop = np.cumsum([len(t) for t in texts])
    start = np.concatenate([[0], stop[:-1]])
    mark = np.zeros(len(least) + 1, np.int32)
    mark[start] += 1
    np.add.at(mark, stop - SPAN + 1, -1)
    inside = np.cumsum(mark[: len(least)]) > 0
    # a place is an anchor if its hash is the least of some window over it, which then is the largest of these minima
    around = np.concatenate([np.zeros(_WINDOW - 1, _U), np.where(inside, least, _U(0)), np.zeros(_WINDOW - 1, _U)])
    best = _sliding(around, _WINDOW, np.maximum)[: len(h)]
    place = np.flatnonzero((h == best) & (best > 0))
    text = np.searchsorted(stop, place, side="right")
    before = np.flatnonzero(place - REACH >= start[text])
    behind = np.flatnonzero(place + GRAM + REACH <= stop[text])
    key = np.concatenate([_sided(h, place[before], place[before] - REACH, 1), _sided(h, place[behind], place[behind] + REACH, 2)])
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    new[start] = True
    first = np.flatnonzero(new)
    owner = np.searchsorted(stop, first, side="right")
    last = np.minimum(np.append(first[1:] - 1, len(least) - 1), stop[owner] - SPAN)
    return (place, h[place]), (np.concatenate([before, behind]), key), (owner, first - start[owner], last - start[owner], least[first], first)


def runs_of(place: np.ndarray, h: np.ndarray, least: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each anchor's run: strings over one place of which it is the least are neighbours, so it is the nearest before with its hash."""
    at = np.searchsorted(first, place, side="right") - 1
    open_ = np.flatnonzero(least[at] != h)
    while len(open_):
        at[open_] -= 1
        open_ = open_[least[at[open_]] != h[open_]]
    return at


def suffix_array(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of all suffixes of pieces of the given sizes that lie side by side; each ends in a symbol of its own, below all bytes."""
    end = np.repeat(np.cumsum(size), size)
    piece = np.repeat(np.arange(len(size)), size)
    rank = _ranked(_words(data, end))
    step, place = STEP, np.arange(len(data))
    while True:
        open_ = np.flatnonzero(_tied(rank))
        if not len(open_):
            break
        after = np.minimum(open_ + step, len(data) - 1)
        following = np.where(open_ + step < end[open_], rank[after], -1 - piece[open_])
        # tied groups are refined in place: a member's new rank is its group's first plus its order inside it
        own = np.lexsort((following, rank[open_]))
        group, order, after = rank[open_][own], open_[own], following[own]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_key = new_group | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(order))
        head = np.maximum.accumulate(np.where(new_group, at, 0))
        rank[order] = group + (np.maximum.accumulate(np.where(new_key, at, 0)) - head)
        step *= 2
    out = np.empty(len(data), np.int64)
    out[rank] = place
    return out


def _words(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The STEP symbols from each place as a number, nine bits each: a byte and one, or zero behind a piece's end."""
    key = np.zeros(len(data), _U)
    symbols = np.concatenate([data.astype(_U) + _U(1), np.zeros(STEP, _U)])
    left = end - np.arange(len(data))
    for i in range(STEP):
        key = (key << _U(9)) | np.where(left > i, symbols[i : i + len(data)], _U(0))
    return key


def common_prefixes(data: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, by its place, how many bytes it shares with the one before it in the order. Kasai's rule in numpy.

    Where the bytes in front of both are equal a suffix shares one byte less than the suffix one place to its left; the
    others are compared, STEP bytes at a time.
    """
    n = len(data)
    end = np.repeat(np.cumsum(size), size)
    begin = end - np.repeat(size, size)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    front = np.maximum(before, 1) - 1
    follows = (before >= 0) & (place > begin) & (before > begin[np.maximum(before, 0)]) & (data[np.maximum(place - 1, 0)] == data[front])
    shared = np.zeros(n, np.int64)
    i = np.flatnonzero(~follows & (before >= 0))
    words, most = _words(data, end), np.minimum(end[i] - i, end[before[i]] - before[i])
    open_, done = np.arange(len(i)), np.zeros(len(i), np.int64)
    while len(open_):
        x, y = i[open_] + done[open_], before[i[open_]] + done[open_]
        differ = words[x] ^ words[y]
        # the symbol of the highest bit in which they differ; floats hold 53 bits exactly
        high = np.frexp((differ >> _U(10)).astype(np.float64))[1] + 9
        same = np.where(differ < _U(1 << 10), np.where(differ < _U(1 << 9), STEP - 1, STEP - 2), (9 * STEP - 1 - high) // 9)
        same = np.where(differ == 0, STEP, same)
        done[open_] = np.minimum(done[open_] + same, most[open_])
        open_ = open_[(differ == 0) & (done[open_] < most[open_])]
    shared[i] = done
    # the rest: counted down from the last compared place
    last = np.maximum.accumulate(np.where(follows, 0, place))
    return np.where(follows, shared[last] - (place - last), shared)


def equal_strings(data: np.ndarray, size: np.ndarray, judged: np.ndarray) -> np.ndarray:
    """A number for each judged place, rising in the strings' order, equal where the SPAN bytes from there are equal. All lie inside their pieces."""
    order = suffix_array(data, size)
    number = np.empty(len(data), np.int64)
    number[order] = np.cumsum(common_prefixes(data, size, order)[order] < SPAN)
    return number[judged]


def _ranked(key: np.ndarray) -> np.ndarray:
    """Each key's place in sorted order, the first of equal ones."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), np.arange(len(key)), 0))
    rank = np.empty(len(key), np.int64)
    rank[order] = first
    return rank


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.bincount(rank, minlength=len(rank))[rank] > 1


def _prepared(docs: DataFrame) -> DataFrame:
    """(doc, tid, digest, data): order of documents, a number for the text, the text's digest."""
    data = text_or_empty().cast("binary")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc"), F.xxhash64(data).alias("tid"), F.sha2(data, 256).alias("digest"), data.alias("data"))


SENT_ROWS = 4_000_000  # rows of 8 bytes that are sent to executors; more are joined


def _row_number(doc, tid):
    return F.xxhash64(doc, tid)


def _repeats(rows: DataFrame, partitions: int) -> DataFrame:
    """(number) of rows whose whole text an earlier document has.

    A group with over an eighth of a partition's share of the rows is met by broadcast, so that no task gets all
    of its copies: there are fewer than 8 such groups a partition. The others are joined.
    """
    heads = cut(rows.where(F.length("data") >= SPAN).select("doc", "tid", F.unhex("digest").alias("digest")))
    groups = heads.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("copies"))
    groups = cut(groups.where("first < last").select("digest", "first", "copies"))
    crowd = F.col("copies") > heads.count() // (8 * partitions)
    crowded = F.broadcast(groups.where(crowd).select("digest", F.col("first").alias("crowd_first")))
    marked = heads.join(crowded, "digest", "left")
    few = marked.where("crowd_first is null").join(groups.where(~crowd).select("digest", "first"), "digest").where("doc > first")
    later = marked.where("doc > crowd_first").select("doc", "tid").unionAll(few.select("doc", "tid"))
    return cut(later.select(_row_number("doc", "tid").alias("number")).distinct())


def _firsts(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rows that have SPAN bytes and no earlier copy."""
    numbered = rows.where(F.length("data") >= SPAN).withColumn("number", _row_number("doc", "tid"))
    small = repeats.count() <= SENT_ROWS
    return numbered.join(F.broadcast(repeats) if small else repeats, "number", "left_anti").select("doc", "tid", "data")


FILTER_BITS = (27, 30)  # least and most: 16 to 128 MB


def _anchor_counts(firsts: DataFrame) -> DataFrame:
    """(key, n) of anchors' keys that occur more than once. Checkpointed."""

    def run(batches):
        for batch in batches:
            data = batch.column("data").to_pylist()
            for a, b in by_bytes(data, _SLICE):
                found, n = np.unique(anchors(data[a:b])[1][1].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(found), "n": pa.array(n, pa.int64())})

    counted = firsts.select("data").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return cut(counted.where("n > 1"))


def _contexts(firsts: DataFrame, bits: bytes, crowded: dict[int, int]) -> DataFrame:
    """Each run of strings whose anchor may be repeated, with its bytes; runs of crowded anchors are dealt to parts."""
    sent = firsts.sparkSession.sparkContext.broadcast((bits, crowded))

    def run(batches):
        known, parts_of = np.frombuffer(sent.value[0], np.uint8), sent.value[1]
        for batch in batches:
            docs, tids, data = (batch.column(c).to_pylist() for c in ("doc", "tid", "data"))
            for a, b in by_bytes(data, _SLICE):
                (spot, h), (of, side_key), (owner, first, last, least, begin) = anchors(data[a:b])
                slot = (side_key & _U(8 * len(known) - 1)).astype(np.int64)
                seen = np.unique(of[((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1) > 0])
                may = np.unique(runs_of(spot[seen], h[seen], least, begin))
                # long runs, of periodic text, are cut; every string is in one piece
                cuts = (last[may] - first[may]) // RUN + 1
                nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                may = np.repeat(may, cuts)
                own, key, i = owner[may].tolist(), least[may].view(np.int64).tolist(), (first[may] + nth * RUN).tolist()
                j = np.minimum(last[may], first[may] + nth * RUN + RUN - 1).tolist()
                parts = [parts_of.get(k, 1) for k in (least[may] >> _U(64 - _PREFIX)).tolist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array(key, pa.int64()),
                        "part": pa.array([(docs[a + o] * 31 + x) % p if p > 1 else 0 for o, x, p in zip(own, i, parts)], pa.int32()),
                        "split": pa.array([p > 1 for p in parts], pa.bool_()),
                        "doc": pa.array([docs[a + o] for o in own], pa.int64()),
                        "tid": pa.array([tids[a + o] for o in own], pa.int64()),
                        "place": pa.array(i, pa.int64()),
                        "chunk": pa.array([data[a + o][x : y + SPAN] for o, x, y in zip(own, i, j)], pa.binary()),
                    }
                )

    return firsts.mapInArrow(run, "anchor bigint, part int, split boolean, doc bigint, tid bigint, place bigint, chunk binary")


_FOUND = "doc bigint, tid bigint, start bigint, stop bigint, anchor bigint, part int, string binary"


def _rows(doc, tid, start, stop, anchor=None, part=None, string=None) -> pa.RecordBatch:
    none = [None] * len(doc)
    columns = zip((doc, tid, start, stop, *(none if x is None else x for x in (anchor, part, string))), (*[pa.int64()] * 5, pa.int32(), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in columns], ["doc", "tid", "start", "stop", "anchor", "part", "string"])


def _repeats_itself(chunk: bytes) -> bool:
    """Whether two strings of SPAN bytes in it may be equal: then all GRAM-byte strings in the first of them come again."""
    return any(chunk.find(chunk[k : k + GRAM], k + 1) >= 0 for k in range(0, len(chunk) - GRAM, _WINDOW - 1))


def _shard(rows: dict[str, list]) -> list[pa.RecordBatch]:
    """Of equal chunks all but the earliest go whole; those that are left and may still share strings are sorted."""
    order = sorted(range(len(rows["chunk"])), key=lambda i: (rows["doc"][i], rows["tid"][i], rows["place"][i]))
    place_of = lambda i: (rows["doc"][i], rows["tid"][i], rows["place"][i])
    first: dict[tuple[int, bytes], int] = {}
    whole = []
    for i in order:
        j = first.setdefault((rows["anchor"][i], rows["chunk"][i]), i)
        if j != i and place_of(i) != place_of(j):
            whole.append(i)
    under = Counter(a for a, _ in first)
    left = [i for (a, c), i in first.items() if under[a] > 1 or rows["split"][i] or _repeats_itself(c)]
    out = []
    if whole:
        doc, tid, start = ([rows[n][i] for i in whole] for n in ("doc", "tid", "place"))
        out.append(_rows(doc, tid, start, [rows["place"][i] + len(rows["chunk"][i]) for i in whole]))
    if left:
        out += _sorted_strings({n: [v[i] for i in left] for n, v in rows.items()})
    return out


def _sorted_strings(rows: dict[str, list]) -> list[pa.RecordBatch]:
    """One suffix array: intervals that repeat an earlier place of the shard; of split anchors also each string's first place, in the strings' order."""
    chunks = rows["chunk"]
    size = np.array([len(c) for c in chunks])
    data = np.frombuffer(b"".join(chunks), np.uint8)
    strings = size - SPAN + 1
    at = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    judged = np.repeat(np.cumsum(size) - size, strings) + at
    number = equal_strings(data, size, judged)
    doc, tid, split, anchor, part = (np.repeat(np.array(rows[c]), strings) for c in ("doc", "tid", "split", "anchor", "part"))
    place = np.repeat(np.array(rows["place"]), strings) + at
    order = np.lexsort((place, tid, doc, number))
    first = np.concatenate([[True], number[order][1:] != number[order][:-1]])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    again = (place[order] == place[head]) & (doc[order] == doc[head]) & (tid[order] == tid[head])  # a repeated row is no earlier place
    later, out = order[~again], []
    if len(later):
        later = later[np.lexsort((place[later], tid[later], doc[later]))]
        d, t, p = doc[later], tid[later], place[later]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + 1)])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:] - 1, len(later) - 1)
        out.append(_rows(d[begin], t[begin], p[begin], p[end] + SPAN))
    firsts = order[first]
    if len(firsts := firsts[split[firsts]]):
        raw = data.tobytes()
        out.append(_rows(doc[firsts], tid[firsts], place[firsts], place[firsts] + SPAN, anchor[firsts], part[firsts], [raw[j : j + SPAN] for j in judged[firsts].tolist()]))
    return out


def _merged(batches):
    """Rows (anchor, slot, part, string, doc, tid, start) sorted by the first four: places that another shard has earlier.

    The strings of each part are searched, in halves, in what the parts before it have together.
    """
    kind = np.dtype([("doc", np.int64), ("tid", np.int64), ("start", np.int64)])
    key, part, held = None, None, ([], [])
    known, least = np.zeros(0, f"S{SPAN}"), np.zeros(0, kind)
    out: list[np.ndarray] = []

    def close_part() -> None:
        nonlocal known, least, held
        if not held[0]:
            return
        strings, places = np.array(held[0], f"S{SPAN}"), np.array(held[1], kind)
        held = ([], [])
        at = np.searchsorted(known, strings)
        met = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == strings) if len(known) else np.zeros(0, np.int64)
        old, new = least[at[met]], places[met]
        earlier = np.array([tuple(x) < tuple(y) for x, y in zip(new.tolist(), old.tolist())], bool)
        equal = new == old  # a repeated row
        out.append(np.where(earlier, old, new)[~equal])
        least[at[met]] = np.where(earlier, new, old)
        fresh = np.ones(len(strings), bool)
        fresh[met] = False
        known, least = np.insert(known, at[fresh], strings[fresh]), np.insert(least, at[fresh], places[fresh])

    def rows() -> pa.RecordBatch:
        every = np.concatenate(out) if out else np.zeros(0, kind)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (every["doc"], every["tid"], every["start"], every["start"] + SPAN)], ["doc", "tid", "start", "stop"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "slot", "part", "string", "doc", "tid", "start")]
        for anchor, slot, p, string, *place in zip(*columns):
            if (anchor, slot) != key:
                close_part()
                key, part, known, least = (anchor, slot), p, np.zeros(0, f"S{SPAN}"), np.zeros(0, kind)
            elif p != part:
                close_part()
                part = p
            if not held[0] or held[0][-1] != string:
                held[0].append(string)
                held[1].append(tuple(place))
            else:  # a shard of the same part has it as well
                low, high = sorted((held[1][-1], tuple(place)))
                held[1][-1] = low
                if low != high:
                    out.append(np.array([high], kind))
        yield rows()
    close_part()
    yield rows()


def _shards(batches):
    """Rows sorted by anchor and part: whole groups are gathered into suffix arrays of about _SHARD bytes."""
    names = ("anchor", "part", "split", "doc", "tid", "place", "chunk")
    held: dict[str, list] = {n: [] for n in names}
    size = 0
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in names}
        for i in range(batch.num_rows):
            same = held["anchor"] and (held["anchor"][-1], held["part"][-1]) == (columns["anchor"][i], columns["part"][i])
            if size > _SHARD and not same:
                yield from _shard(held)
                held, size = {n: [] for n in names}, 0
            for n in names:
                held[n].append(columns[n][i])
            size += len(columns["chunk"][i])
    if size:
        yield from _shard(held)


def removals(docs: DataFrame, partitions: int | None = None, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows prepared, numbers of whole repeats, and (number, spans) of what else goes: array<struct<start, stop>>, unmerged."""
    spark = docs.sparkSession
    partitions = partitions or shuffle_partitions(spark)
    rows = _prepared(docs)
    repeats = _repeats(rows, partitions)
    firsts = _firsts(rows, repeats)
    repeated = _anchor_counts(firsts)
    total = int(repeated.agg(F.sum("n")).first()[0] or 0)
    most = max(hot, total // (128 * partitions))  # an anchor has two keys; so at most 64 prefixes a partition are crowded
    by_prefix = repeated.groupBy(F.shiftrightunsigned("key", 64 - _PREFIX).alias("prefix")).agg(F.ceil(F.sum("n") / 2).alias("n"))
    crowded = {r["prefix"]: -(-r["n"] // most) for r in by_prefix.where(F.col("n") > most).collect()}
    contexts = _contexts(firsts, bit_filter(repeated, "key", FILTER_BITS), crowded)
    found = written(contexts.repartition(partitions, "anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_shards, _FOUND))
    inside = found.where("string is null").select("doc", "tid", "start", "stop")
    slot = F.pmod(F.xxhash64("string"), F.lit(SLOTS)).cast("int").alias("slot")
    split = found.where("string is not null").select("anchor", slot, "part", "string", "doc", "tid", "start").repartition(partitions, "anchor", "slot")
    across = split.sortWithinPartitions("anchor", "slot", "part", "string").mapInArrow(_merged, "doc bigint, tid bigint, start bigint, stop bigint")
    spans = inside.unionAll(across).groupBy(_row_number(F.col("doc"), F.col("tid")).alias("number")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows, repeats, spans


def deduplicated(docs: DataFrame, partitions: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; kept is binary."""
    rows, repeats, spans = removals(docs, partitions, hot)
    marks = cut(spans.unionAll(repeats.select("number", F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))))
    slim = rows.select("doc_id", _row_number("doc", "tid").alias("number"), "data").join(marks, "number", "left").select("doc_id", "data", "spans")

    def run(batches):
        for batch in batches:
            data, every = batch.column("data").to_pylist(), batch.column("spans").to_pylist()
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, spans in zip(data, every):
                kept, removed, runs, at = [], 0, 0, 0
                if spans is not None and not spans:
                    removed, runs, at = len(text), 1, len(text)
                end = None
                for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if end is None or s[0] > end:
                        if end is not None:
                            at = end
                        kept.append(text[at : s[0]])
                        runs += 1
                        removed += s[1] - s[0]
                        end = s[1]
                    elif s[1] > end:
                        removed += s[1] - end
                        end = s[1]
                kept.append(text[(end if end is not None else at) :])
                for name, value in zip(out, (len(text), removed, runs, b"".join(kept))):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{n: pa.array(v, pa.binary() if n == "kept" else pa.int64()) for n, v in out.items()}})

    return slim.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
