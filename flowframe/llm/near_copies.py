"""Near copies: texts whose sets of word shingles have a likeness (Jaccard) of LIKENESS or more.

Candidates meet under keys that lose no link: in any order of all shingles, two sets of that likeness
share one of their first n - ceil(LIKENESS n) + 1 shingles (n is a set's size). The order puts rare
shingles first, by counts in a sample of texts; which texts are sampled changes the cost alone. Within
a key, pairs go whose sizes and places in the order forbid the likeness (before the first shingle they share
they have none in common, so what follows it must do). Of sets of under WIDE shingles those go whose parities (64 bits, each the
parity of the shingles that fall on it) differ in more bits than so like sets have shingles apart: that loses
nothing. Larger ones go when their SimHashes over the same shingles are more than BITS_APART apart: a table of
distances to pivots discards first, as in simhash_pivots; and when these and a second 64 bits are more than
BITS_OF_BOTH apart together. Sets of likeness 0.8 differ in 10 bits of 64 as a rule, and in more than 24 about
three times in a million; in 20 of 128, and in more than 44 some hundred times less often than that. Without the second word,
one unrelated pair in thirty that meets passes, and the chance links of a large table tie most of it together.
Sets of under SMALL shingles, whose fingerprints vary more, are not judged by SimHash. Keys with over GROUP texts
tie all of these together. The components of the candidates are then judged exactly, each by itself, on the sets
themselves: what has not the likeness is no link. Large components are judged block against block, in as many
rounds as keep a round's copies under twice the candidates' texts.

Defined results: equal texts are one node; null and empty texts are equal; rows that share a doc_id but not
the text are judged apart; a row without doc_id gets the component of its group, null if nobody in it has an id,
and stays only if nobody has.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, lean, row_key, salted, shuffle_partitions, text_or_empty, written
from .components import components
from .simhash_pivots import PIVOTS, shingle_hashes, simhash_of

SHINGLE, LIKENESS, BITS_APART, SMALL = 5, 0.8, 24, 32
WIDE, BITS_OF_BOTH = 80, 44
GROUP, PAIRED = 4096, 64  # texts of a key that are compared at all, and those of which all pairs are laid out at once
FILTER_BITS = (16, 27)
BLOCK_BYTES = 2_000_000  # of the texts of a component that are judged together
#: Texts whose shingles are counted for the order, and how many of the most frequent shingles are sent.
SAMPLED, FREQUENT = 20_000, 1 << 18


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes, sorted; the empty text has one of its own."""
    return np.unique(np.array(shingle_hashes(data, shingle) or [0], np.uint64)).view(np.int64)


def prefix(found: np.ndarray, frequent: np.ndarray, count: np.ndarray, likeness: float) -> np.ndarray:
    """The first shingles of a set in the order (count among the frequent, hash)."""
    n = len(found)
    kept = n - math.ceil(likeness * n - 1e-9) + 1
    if not len(frequent):
        return np.sort(found)[:kept]
    place = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    rank = np.where(frequent[place] == found, count[place], 0)
    return found[np.lexsort((found, rank))[:kept]]


def alike(a: np.ndarray, b: np.ndarray, likeness: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= likeness * (len(a) + len(b) - both) - 1e-9


def second_word(found: np.ndarray) -> int:
    """Signed 64 bits: parities of a set of under WIDE shingles, a second SimHash of a larger one."""
    found = found.view(np.uint64)
    if len(found) < WIDE:
        return int(np.bitwise_xor.reduce(np.uint64(1) << (found >> np.uint64(58))).view(np.int64))
    with np.errstate(over="ignore"):
        mixed = (found ^ (found >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return simhash_of(mixed ^ (mixed >> np.uint64(33)))


def _passing(i: np.ndarray, j: np.ndarray, held: dict[str, np.ndarray], likeness: float, bits: int) -> np.ndarray:
    """Which pairs (i, j) of places that share a key may be alike, by sizes, places in the order, and bits."""
    size, at = held["size"], held["at"]
    need = np.ceil(likeness / (1 + likeness) * (size[i] + size[j]) - 1e-9)
    left = np.flatnonzero(np.minimum(size[i] - at[i], size[j] - at[j]) >= need)
    i, j, need = i[left], j[left], need[left]
    least, most = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    second = np.bitwise_count(held["more"][i] ^ held["more"][j])
    good = (most >= WIDE) | (second <= size[i] + size[j] - 2 * need)
    by_bits = np.flatnonzero((least >= SMALL) & (most >= WIDE))
    a, b = i[by_bits], j[by_bits]
    near = np.abs(held["pivots"][a] - held["pivots"][b]).max(1, initial=0) <= bits
    first = np.bitwise_count(held["fp"][a] ^ held["fp"][b])
    near &= first <= bits
    near &= (least[by_bits] < WIDE) | (first + second[by_bits] <= BITS_OF_BOTH)
    good[by_bits] = near
    return left[good]


def _of_groups(starts: np.ndarray, stops: np.ndarray, held: dict[str, np.ndarray], likeness: float, bits: int):
    """Pairs of places that pass, of groups of up to PAIRED rows, in parts."""
    part, pairs = 0, np.cumsum((stops - starts) * (stops - starts - 1) // 2)
    while part < len(starts):
        until = max(np.searchsorted(pairs, (pairs[part - 1] if part else 0) + (1 << 18), side="right"), part + 1)
        count = stops[part:until] - starts[part:until]
        row = np.repeat(starts[part:until], count) + _counted(count)
        after = np.repeat(stops[part:until], count) - row - 1
        i = np.repeat(row, after)
        j = i + 1 + _counted(after)
        passed = _passing(i, j, held, likeness, bits)
        yield i[passed], j[passed]
        part = until


def _counted(count: np.ndarray) -> np.ndarray:
    """0 to count - 1, for each count."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _near(held: dict[str, np.ndarray], likeness: float, bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one key's candidates."""
    order = np.argsort(held["size"], kind="stable")
    held = {k: x[order] for k, x in held.items()}
    size, node = held["size"], held["node"]
    reach = np.searchsorted(size, size / likeness + 1e-9, side="right")
    label, links = np.arange(len(size)), []
    for i in range(len(size) - 1):
        j = np.arange(i + 1, reach[i])
        j = j[label[j] != label[i]]
        if len(j):
            j = j[_passing(np.full(len(j), i), j, held, likeness, bits)]
        for k in j.tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                links.append((int(node[i]), int(node[k])))
    return links


def _candidates(likeness: float, bits: int):
    names, most = ("key", "node", "fp", "more", "place"), GROUP

    def run(batches):
        held, over = None, None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in names]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            key = held[0]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(1, int)
            last = starts[-1]
            links = joined([x[:last] for x in held], over)
            held = [x[last:] for x in held]
            if len(held[0]) and (len(held[0]) > most or held[0][0] == over):
                over = int(held[0][0])
                links += star(held[1])
                held = [x[:1] for x in held]
            yield rows(links)
        if held is not None:
            yield rows(joined(held, over))

    def star(node: np.ndarray) -> list[tuple[int, int]]:
        return [(int(node[0]), int(x)) for x in np.unique(node[1:]) if x != node[0]]

    def joined(held: list[np.ndarray], over) -> list[tuple[int, int]]:
        """Links of whole keys; rows are sorted by key and node."""
        key, node, fp, more, place = held
        if not len(key):
            return []
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key = key[fresh]
        alone = np.concatenate([[True], key[1:] != key[:-1]]) & np.concatenate([key[1:] != key[:-1], [True]])
        key, node, fp, more, place = (x[~alone] for x in (key, node[fresh], fp[fresh], more[fresh], place[fresh]))
        if not len(key):
            return []
        fp = fp.view(np.uint64)
        pivots = np.stack([np.bitwise_count(fp ^ p) for p in PIVOTS], 1).astype(np.int8)
        rows = {"node": node, "fp": fp, "more": more.view(np.uint64), "size": place >> 32, "at": place & 0xFFFFFFFF, "pivots": pivots}
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        stops = np.append(starts[1:], len(key))
        few = stops - starts <= PAIRED
        if over is not None:
            few &= key[starts] != over
        links = set()
        for i, j in _of_groups(starts[few], stops[few], rows, likeness, bits):
            links.update(zip(node[i].tolist(), node[j].tolist()))
        for a, b in zip(starts[~few].tolist(), stops[~few].tolist()):
            links.update(star(node[a:b]) if key[a] == over else _near({k: x[a:b] for k, x in rows.items()}, likeness, bits))
        return list(links)

    def rows(links: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})

    return run


def judged(sets: list[np.ndarray], likeness: float) -> np.ndarray:
    """For each of some sets the number of its component, by exact likeness."""
    label = np.arange(len(sets))
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    keys = [np.searchsorted(every, prefix(sets[i], every, count, likeness)) for i in order]
    met = defaultdict(list)  # by key the sets that have it, smaller ones first
    for at, found in enumerate(keys):
        for k in found.tolist():
            met[k].append(at)
    met = {k: np.array(x) for k, x in met.items() if len(x) > 1}
    for at, found in enumerate(keys):
        i, shares = order[at], np.zeros(len(sets), bool)
        for k in found.tolist():
            if k in met:
                shares[met[k]] = True
        others = np.array(order)[np.flatnonzero(shares[:at])]
        while len(others := others[label[others] != label[i]]):
            j, others = others[-1], others[:-1]
            if len(sets[j]) >= likeness * len(sets[i]) - 1e-9 and alike(sets[i], sets[j], likeness):
                label[label == label[j]] = label[i]
    return label


def _verified(shingle: int, likeness: float):
    """Links that span what is alike among the texts of each group; rows are sorted by group."""

    def run(batches):
        key, nodes, sets = None, [], []

        def close():
            label = judged(sets, likeness) if len(sets) > 1 else np.zeros(len(sets), np.int64)
            least = {}
            for n, x in zip(nodes, label.tolist()):
                least[x] = min(n, least.get(x, n))
            found = [(n, least[x]) for n, x in zip(nodes, label.tolist()) if n != least[x]]
            return pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64()), "final": pa.array([bool(key and key[3] == 1)] * len(found), pa.bool_())})

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for *group, n, data in zip(*(part.column(c).to_pylist() for c in ("root", "low", "high", "blocks", "node", "data"))):
                    if group != key:
                        yield close()
                        key, nodes, sets = group, [], []
                    nodes.append(n)
                    sets.append(shingle_set(data, shingle))
        yield close()

    return run


def _block_pairs(texts: DataFrame):
    """(root, low, high, blocks, node, data), round by round: what every two blocks of a component hold, and those of one block.

    A text of n blocks is sent n times in all. The copies of a round are under about twice the bytes of texts.
    """
    size = texts.groupBy("root").agg(F.sum(F.octet_length("data")).alias("bytes"))
    size = size.withColumn("blocks", F.greatest(F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int"))
    sums = size.agg(F.sum("bytes"), F.sum(F.col("bytes").cast("double") * F.col("blocks"))).first()
    rounds = max(int((sums[1] or 0) // max(sums[0] or 0, 1)), 1)
    large = written(size.where("blocks > 1").select(F.col("root").alias("__root"), "blocks"))
    own = texts.join(F.broadcast(large), F.col("root") == F.col("__root"), "left").select("root", F.coalesce("blocks", F.lit(1)).alias("blocks"), "node", "data")
    own = own.withColumn("own", F.pmod(F.xxhash64("node", "root"), F.col("blocks")).cast("int"))

    def in_round(number: int):
        return lambda other: F.pmod(F.xxhash64("root", F.least("own", other), F.greatest("own", other)), F.lit(rounds)) == number

    for number in range(rounds):
        met = own.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), in_round(number))))
        yield met.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "blocks", "node", "data")


def _verified_groups(texts: DataFrame, partitions: int, shingle: int, likeness: float) -> DataFrame:
    """(node, group) of texts that are alike, out of (root, node, data), the components of candidates.

    A component of over BLOCK_BYTES is cut into blocks, and every two blocks are judged by one task, so that none holds
    more than two; what such tasks find is put together by another round of components.
    """
    order, links = ("root", "low", "high"), None
    for met in _block_pairs(texts):
        found = written(met.repartition(partitions, *order).sortWithinPartitions(*order).mapInArrow(lean(_verified(shingle, likeness)), "u bigint, v bigint, final boolean"))
        links = found if links is None else links.unionAll(found)
    done = links.where("final").select(F.col("u").alias("node"), F.col("v").alias("group"))
    open_ = links.where("not final").select("u", "v")
    if open_.isEmpty():
        return done
    return done.unionAll(components(open_).select(F.col("u").alias("node"), F.col("root").alias("group")))


def _texts_of(slim: DataFrame, members: DataFrame) -> DataFrame:
    """(root, node, data) of the members; a filter leaves most other texts behind before the rest are shuffled."""
    sent = slim.sparkSession.sparkContext.broadcast(bit_filter(members, "member", FILTER_BITS))

    def run(batches):
        known = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            slot = batch.column("node").to_numpy() & (8 * len(known) - 1)
            yield batch.filter(pa.array((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))

    some = slim.mapInArrow(lean(run), "node bigint, data binary")
    return written(some.join(members, F.col("node") == F.col("member")).select("root", "node", "data").dropDuplicates(["node"]))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, likeness: float = LIKENESS, bits: int = BITS_APART) -> DataFrame:
    """(row, doc_id, component_id, stays) for each row of docs: the smallest doc_id among its near copies, and whether it is the one that stays.

    row: `common.row_key`; rows that share it are one document.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    text = text_or_empty().cast("binary")
    slim = docs.select(F.xxhash64(text).alias("node"), text.alias("data"))
    share = max(docs.count() // SAMPLED, 1)

    def shingles(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                sets = [shingle_set(x.as_py(), shingle) for x in batch.column("data").slice(i, 500)]
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate(sets) if sets else [], pa.int64())})

    sample = slim.where(F.pmod("node", F.lit(share)) == 0).dropDuplicates(["node"]).mapInArrow(lean(shingles), "shingle bigint")
    often = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas().sort_values("shingle")
    sent = docs.sparkSession.sparkContext.broadcast((often["shingle"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))

    def keys(batches):
        seen = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out = []
                for n, data in zip(part.column("node").to_pylist(), part.column("data")):
                    if n not in seen:
                        seen.add(n)
                        found = shingle_set(data.as_py(), shingle)
                        out.append((prefix(found, *sent.value, likeness), n, simhash_of(found.view(np.uint64)), second_word(found), len(found)))
                times = np.array([len(x[0]) for x in out], np.int64)
                of_text = [np.repeat(np.array([x[c] for x in out], np.int64), times) for c in (1, 2, 3, 4)]
                columns = [np.concatenate([x[0] for x in out]) if out else [], *of_text[:3], of_text[3] << 32 | _counted(times)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "node", "fp", "more", "place"])

    keyed = slim.mapInArrow(lean(keys), "key bigint, node bigint, fp bigint, more bigint, place bigint")
    keyed = keyed.repartition(partitions, "key").sortWithinPartitions("key", "node")
    roots = components(keyed.mapInArrow(lean(_candidates(likeness, bits)), "u bigint, v bigint"))
    members = written(roots.select(F.col("u").alias("member"), "root").unionAll(roots.select(F.col("root").alias("member"), "root").distinct()))
    groups = _verified_groups(_texts_of(slim, members), partitions, shingle, likeness)
    # equal texts are put together first, then groups; of a group the row with the least id stays, rows without one come last
    rows = written(docs.select(row_key().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("node")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    nodes = rows.groupBy("node").agg(first).join(groups, "node", "left").select("node", F.coalesce("group", "node").alias("group"), "first")
    nodes = written(nodes)
    best = nodes.groupBy("group").agg(F.min("first").alias("best"))
    of_node = salted(nodes, best, "group", "node").select("node", "best")
    return salted(rows, of_node, "node", "row").select("row", "doc_id", F.col("best.doc_id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("stays"))
