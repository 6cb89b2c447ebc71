"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by taking, again and again, the longest prefix that the model's compiled
character map knows; each normalised byte remembers the source byte it came from. The normalised
text is cut where no piece can cross (before a run of space symbols), every distinct cut is
segmented once, and the pieces' normalised extents are projected to byte spans of the source.

Defined results: a null text counts as empty; an empty text has no pieces, and decodes to "".
Repeated rows give repeated results; other columns are left out of `encode` and never clash.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, free_name, lean, table, text_or_empty

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_REPLACEMENT = "�".encode()
SLICE = 500_000  # characters of text whose pieces leave a worker at once: some 4 MB of ids and spans
REMEMBERED = 100_000  # distinct cuts beyond which a worker of `tokenized` empties its memory before the next slice
_NORMAL, _UNKNOWN, _USER_DEFINED, _UNUSED, _BYTE = 1, 2, 4, 5, 6


class CharMap:
    """The compiled character map: a double-array trie whose leaves point into a pool of strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest known prefix of data[at:]."""
        units, best = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = units[node] & 0x7FFFFFFF, i + 1 - at
        if best is None:
            return None
        return self.pool[best[0] : self.pool.index(0, best[0])], best[1]


class Codec:
    """One model: `encode` texts to ids and source spans, `decode` ids."""

    CACHED = 300_000  # distinct cuts a worker remembers; beyond it the memory is emptied and refilled

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.spec = sentencepiece_model_pb2.NormalizerSpec()
        self.spec.CopyFrom(proto.normalizer_spec)
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that take white space as a suffix are not supported")
        self.map = CharMap(self.spec.precompiled_charsmap) if self.spec.precompiled_charsmap else None
        self.user = sorted((p.piece.encode() for p in proto.pieces if p.type == _USER_DEFINED), key=len, reverse=True)
        self.plain = not (self.map or self.user or self.spec.remove_extra_whitespaces)
        self.byte_piece = np.array([p.type == _BYTE for p in proto.pieces])
        self.size = np.array([0 if p.type in (_BYTE, _UNKNOWN) else len(p.piece.encode()) for p in proto.pieces], np.int64)
        crossing = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type in (_NORMAL, _USER_DEFINED, _UNUSED))
        self.cuts = re.compile(r"(?s).+" if crossing else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto.normalizer_spec.Clear()  # the segmenter gets normalised text
        proto.normalizer_spec.name = "identity"
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.remove_extra_whitespaces = False
        proto.normalizer_spec.escape_whitespaces = False
        proto.denormalizer_spec.Clear()
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    def forget(self) -> None:
        """Drop the remembered cuts."""
        self.ids_of.clear()
        self.text_of.clear()

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte it starts at."""
        data = text.encode()
        if self.plain:
            return self._normalize_plain(text, data)
        out, origin, at = bytearray(), [], 0
        space = _SPACE_BYTES if self.spec.escape_whitespaces else b" "
        trim = self.spec.remove_extra_whitespaces
        while trim and at < len(data):
            got, used = self._prefix(data, at)
            if got != b" ":
                break
            at += used
        if at == len(data):
            return "", np.zeros(1, np.int64)
        if self.spec.add_dummy_prefix:
            out += space
            origin += [at] * len(space)
        after_space = trim
        while at < len(data):
            got, used = self._prefix(data, at)
            if after_space:
                got = got.lstrip(b" ")
            if got:
                ends_in_space = got[-1:] == b" "
                got = got.replace(b" ", space)
                out += got
                origin += [at] * len(got)
                after_space = trim and ends_in_space
            at += used
        end = len(data)
        while trim and out.endswith(space):
            del out[-len(space) :]
            end = origin[len(out)]
            del origin[len(out) :]
        return out.decode(), np.array([*origin, end], np.int64)

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        for piece in self.user:
            if data.startswith(piece, at):
                return piece, len(piece)
        if self.map and (found := self.map.longest(data, at)):
            return found
        first = data[at]
        used = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at : at + used], used

    def _normalize_plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """Without a character map each character maps to itself: the alignment follows from the spaces."""
        if not data:
            return "", np.zeros(1, np.int64)
        escaped = self.spec.escape_whitespaces
        space = SPACE if escaped else " "
        lead = space if self.spec.add_dummy_prefix else ""
        width = np.ones(len(data), np.int64)
        if escaped:
            width[np.frombuffer(data, np.uint8) == 0x20] = len(_SPACE_BYTES)
            text = text.replace(" ", SPACE)
        origin = np.repeat(np.arange(len(data)), width)
        return lead + text, np.concatenate([np.zeros(len(lead.encode()), np.int64), origin, [len(data)]])

    def _segment(self, cuts: list[str]) -> tuple[np.ndarray, str]:
        """ids of the cuts in a row, and as decimal text; new cuts go to the library in one call."""
        try:
            return self._known(cuts)
        except KeyError:
            new = list({x for x in cuts if x not in self.ids_of})
        if len(self.ids_of) + len(new) > self.CACHED:
            self.forget()
            new = list(set(cuts))
        for cut, ids in zip(new, self.segmenter.encode(new, num_threads=1), strict=True):
            self.ids_of[cut] = np.array(ids, np.int32).tobytes()
            self.text_of[cut] = ",".join(map(str, ids))
        return self._known(cuts)

    def _known(self, cuts: list[str]) -> tuple[np.ndarray, str]:
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, cuts)), np.int32), ",".join(map(self.text_of.__getitem__, cuts))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """ids, first source byte and end of each piece, and the ids as decimal text."""
        normal, origin = self.normalize(text)
        ids, listed = self._segment(self.cuts.findall(normal))
        begin, end = self._spans(ids, normal, origin)
        return ids, begin, end, listed

    def _spans(self, ids: np.ndarray, normal: str, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces' extents in the normalised bytes, projected. Of a character's byte pieces the last one holds its span."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.size[ids]
        odd = size == 0
        if odd.any():
            self._sizes_of_unknown(ids, size, normal, odd)
        stop = np.cumsum(size)
        return origin[stop - size], origin[stop]

    def _sizes_of_unknown(self, ids: np.ndarray, size: np.ndarray, normal: str, odd: np.ndarray) -> None:
        data, at, i = normal.encode(), 0, 0
        for j in np.flatnonzero(odd):
            if j < i:
                continue
            at += int(size[i:j].sum())
            first = data[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            if self.byte_piece[ids[j]]:
                j += width - 1
            size[j] = width
            at += width
            i = j + 1

    def decode(self, ids) -> str:
        return self.decoder.decode(ids.tolist() if isinstance(ids, np.ndarray) else ids)


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for each model and Python worker."""
    key = hashlib.sha1(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, ids, and for each piece its source bytes [begin, end)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        tool = codec(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                rows = [tool.encode(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "ids": pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                        "begins": pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                        "ends": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    }
                )

    return slim.mapInArrow(run, "doc_id bigint, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of frames made by `encode`."""

    def run(batches):
        tool = codec(model)
        for batch in batches:
            texts = [tool.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def tokenized(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with its columns as they are, and ids, begins, ends (source bytes of each piece) and decoded beside them.

    A name that docs has already is lengthened by underscores.
    """
    names = [free_name(docs, n) for n in ("ids", "begins", "ends", "decoded")]
    kinds = ("array<int>", "array<bigint>", "array<bigint>", "string")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{n}` {k}" for n, k in zip(names, kinds))])

    def run(batches):
        tool = codec(model)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for start, stop in by_bytes(texts, SLICE):
                if len(tool.ids_of) > REMEMBERED:
                    tool.forget()
                part = batch.slice(start, stop - start)
                rows = [tool.encode(x) for x in texts[start:stop]]
                made = [pa.array([r[c] for r in rows], pa.list_(k)) for c, k in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                made.append(pa.array([tool.decode(r[0]) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])
        tool.forget()  # some tens of MB, which would stay beside later stages

    return docs.mapInArrow(lean(run), schema)


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Encode and decode each text in one pass, keeping digests: no ids leave the worker.

    spans_sha256: of all first source bytes, then all ends, as 64-bit little-endian numbers.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches):
        tool = codec(model)
        for batch in batches:
            n, ids_sha, decoded_sha, spans_sha = [], [], [], []
            for text in batch.column("text"):
                ids, begin, end, listed = tool.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(listed.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
                spans_sha.append(hashlib.sha256(begin.astype("<i8").tobytes() + end.astype("<i8").tobytes()).hexdigest())
            columns = (pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (ids_sha, decoded_sha, spans_sha)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return slim.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
