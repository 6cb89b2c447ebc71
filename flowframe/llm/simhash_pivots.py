"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified.

Distinct fingerprints are dealt to groups of about GROUP / 4. Two fingerprints that differ in two bits at most
have one of three blocks of bits in common, so each goes to three groups, one for each block, by as many of its
bits as make groups of that size. Inside a group everything is the pivots': a table of Hamming distances to
PIVOTS reference fingerprints, sorted by the first of them, discards each pair with a coordinate difference over
2, as the triangle inequality allows, pivot by pivot, and what is left is compared bit by bit. A group yields
links that span its components, not all pairs. A group of over GROUP fingerprints is dealt again in the same way
by the bits that were not used yet, until none is (2^12 different fingerprints need 12 bits), so that no table
has more rows than that. (The pivots alone can't deal fingerprints out: two unrelated ones are within 2 of each
other on a given pivot about a third of the time.)

Defined results: null and empty texts have fingerprint zero and link like others; equal texts have
equal fingerprints; rows that share a doc_id but not the text have fingerprints of their own and aren't linked
by the id; a row without doc_id gets the component of its group, null if nobody in the group has an id.
"""

from __future__ import annotations

import random
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, salted, shuffle_partitions, table, text_or_empty, written
from .components import components

SHINGLE, SEED, BITS_APART = 3, 42, 2
GROUP, PAIRS = 4096, 1 << 20  # rows of a table of distances at most, and pairs looked at together
PIVOTS = np.array([random.Random(f"pivot {i}").getrandbits(64) for i in range(16)], np.uint64)


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> list[int]:
    """Unsigned hashes of a UTF-8 text's word shingles; a shorter text is one shingle, an empty one none."""
    words = data.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    sizes = [len(w) + 1 for w in words]
    starts = list(accumulate(sizes, initial=0))
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return [digest(joined, SEED)]
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])]


def simhash_of(hashes) -> int:
    """Signed 64-bit fingerprint of shingle hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], np.uint64)
        count += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(data: bytes) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    return simhash_of(shingle_hashes(data))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; no other column is touched."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().cast("binary").alias("data"))

    def run(batches):
        for batch in batches:
            found = [simhash(x.as_py()) for x in batch.column("data")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found, pa.int64())})

    return slim.mapInArrow(run, "doc_id bigint, fp bigint")


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, the least member's place for each place, with the links (i, j) taken in."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for side in (i, j):
            np.minimum.at(new, label[side], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def near_pairs(fp: np.ndarray, bits: int):
    """Pairs (i, j) of places in fp, in parts, that differ in that many bits at most: those the pivots leave, verified."""
    pivots = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(pivots[:, 0], kind="stable")
    fp, pivots = fp[order], pivots[order]
    first = pivots[:, 0]
    reach = np.searchsorted(first, first + np.int8(bits), side="right") - np.arange(len(fp)) - 1
    before = np.concatenate([[0], np.cumsum(reach)])
    start = 0
    while start < len(fp):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + PAIRS, side="right")) - 1)
        n = reach[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for c in range(1, len(PIVOTS)):
            keep = np.abs(pivots[i, c] - pivots[j, c]) <= bits
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        yield order[i[keep]], order[j[keep]]
        start = stop


def _parts(bits: int) -> list[int]:
    """Three masks that share the bits of a mask out evenly."""
    places = [b for b in range(64) if bits >> b & 1]
    return [sum(1 << b for b in places[k::3]) for k in range(3)]


def _dealt(key: int, fp: np.ndarray, rest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, fingerprints and unused bits of a group that is dealt again."""
    keys, rests = [], []
    with np.errstate(over="ignore"):
        for k, part in enumerate(_parts(rest)):
            x = (fp & np.uint64(part)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 3 + k + 1) % 2**64) * np.uint64(0xD6E8FEB86659FD93)
            keys.append(x ^ (x >> np.uint64(32)))
            rests.append(np.full(len(fp), rest & ~part, np.uint64))
    return np.concatenate(keys).view(np.int64), np.tile(fp, 3).view(np.int64), np.concatenate(rests).view(np.int64)


_GROUPED = "kind int, key bigint, fp bigint, rest bigint"


def _link_groups(batches):
    """Rows (key, fp, rest) sorted by key: (kind 0) links of each group as key and fp, or (kind 1) members of larger groups, dealt again."""
    held_key, held, rest, over = None, [], 0, False

    def close():
        fp = np.unique(np.concatenate(held)) if held and not over else np.zeros(0, np.uint64)
        label = np.arange(len(fp))
        for i, j in near_pairs(fp, BITS_APART) if len(fp) > 1 else ():
            label = joined(label, i, j)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return rows(0, fp[linked].view(np.int64), fp[label[linked]].view(np.int64), np.zeros(len(linked), np.int64))

    def rows(kind, key, fp, rest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), *(pa.array(x, pa.int64()) for x in (key, fp, rest))], ["kind", "key", "fp", "rest"])

    for batch in batches:
        key, fp, left = (batch.column(c).to_numpy() for c in ("key", "fp", "rest"))
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            if key[a] != held_key:
                yield close()
                held_key, held, over, rest = int(key[a]), [], False, int(left[a]) % 2**64
            held.append(fp[a:b].view(np.uint64))
            if over or sum(map(len, held)) > GROUP:
                over = True
                yield rows(1, *_dealt(held_key, np.concatenate(held), rest))
                held = []
    yield close()


def links(distinct: DataFrame, partitions: int) -> DataFrame:
    """(u, v) of fingerprints: a spanning set of the links between the rows of distinct (fp)."""
    found = distinct.count()
    bits = min(max((4 * found // GROUP).bit_length(), 1), 21)
    blocks = [sum(1 << (63 - 21 * k - b) for b in range(bits)) for k in range(3)]
    signed = lambda mask: mask - 2**64 if mask >= 2**63 else mask
    group = lambda k: F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(blocks[k])))).alias("key"), F.lit(signed(2**64 - 1 - blocks[k])).alias("rest"))
    todo = distinct.select(F.explode(F.array(*map(group, range(3)))).alias("g"), "fp").select("g.key", "fp", "g.rest")
    every = None
    while True:
        dealt = todo.repartition(partitions, "key").sortWithinPartitions("key")
        made = cut(dealt.mapInArrow(_link_groups, _GROUPED))
        plain = made.where("kind = 0").select(F.col("key").alias("u"), F.col("fp").alias("v"))
        every = plain if every is None else every.unionAll(plain)
        todo = made.where("kind = 1").select("key", "fp", "rest")
        if todo.isEmpty():
            return every


def named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, least) of nodes that are linked: the least id in their component. nodes: (node, id), one row a node."""
    roots = components(edges)
    members = written(roots.select(F.col("u").alias("node"), "root").unionAll(roots.select(F.col("root").alias("node"), "root").distinct()))
    least = members.join(nodes, "node").groupBy("root").agg(F.min("id").alias("least"))
    return salted(members, least, "root", "node").select("node", "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = written(fingerprints(docs))
    distinct = written(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("id")))
    linked = named(links(distinct.select(F.col("node").alias("fp")), shuffle_partitions(docs.sparkSession)), distinct)
    of_print = distinct.join(linked, "node", "left").select(F.col("node").alias("fp"), F.coalesce("least", "id").alias("component_id"))
    return salted(prints, of_print, "fp", "doc_id").select("doc_id", "fp", "component_id")


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
