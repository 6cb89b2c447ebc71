import base64
import hashlib
import re
import zlib

import pytest

from flowframe.llm import compression_quality, deleted_interpolation, disclosure, language_evidence, phrase_fingerprint, sentencepiece_codec, simhash_pivots, string_tiling, suffix_dedup, warc_revisit
from flowframe.llm.registry import QUERIES

#: nulls, empty and long texts, ties, repeated rows, and a column whose name an operator might use itself.
ROWS = [(1, "a b c d e f"), (2, None), (3, ""), (4, "a@b.com +12345678901 " * 40), (4, "a@b.com +12345678901 " * 40), (None, "one two"), (5, "x" * 5000), (6, "é 😀 " * 300), (7, " \n\t ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 0) for r in ROWS], "doc_id bigint, text string, number string, kind int")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, number string, kind int")


def test_every_operator_takes_odd_and_empty_tables(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id bigint, quality int")
    benchmark = spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "item_id bigint, text string")
    for frame, n in ((docs, len(ROWS)), (no_docs, 0)):
        assert disclosure.spans(frame).count() == n == disclosure.sanitised(frame).count()
        assert phrase_fingerprint.edited_pairs(frame).count() == n
        assert simhash_pivots.near_duplicates(frame).count() == n
        assert sentencepiece_codec.digests(frame, sentencepiece_codec.default_model()).count() == n
        assert deleted_interpolation.scores(frame).count() == n
        assert suffix_dedup.deduplicated(frame).count() == n
        assert compression_quality.score(frame, compression_quality.fit(frame, labels)).count() == n
    assert [(r.doc_id, r.item_id) for r in string_tiling.matches(docs, benchmark).collect()] == [(1, 2)]
    assert string_tiling.matches(no_docs, benchmark).count() == 0 == string_tiling.matches(docs, benchmark.limit(0)).count()
    sanitised = disclosure.sanitised(docs).where("doc_id = 4").first()
    assert "[email]" in sanitised.text and "@" not in sanitised.text and sanitised.number == "x"


def _brute_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (name, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": name == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[name]:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_base_spans_equal_brute_force(spark):
    texts = ["a@b.com_x@c.org 1.2.3.4.5.6.7.8", "4111 1111-1111 1111 +1 (234) 567-8901 😀 x@y.z", "0001.2.3.4 256.1.1.1 1.2.3", "9" * 3000, "1.1.1.1 " * 300]
    found = disclosure.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in found:
        assert r.base_sha256 == hashlib.sha256(_brute_spans(texts[r.doc_id]).encode()).hexdigest()


def test_disclosing_terms_are_found_and_common_words_left(spark):
    rows = [(i, f"the owner zanzibar the mail x{'.'}y@z.org and the end") for i in range(5)] + [(10 + i, f"the quick mail and the owner end number {i} of the day") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = disclosure.sanitised(frame).where("doc_id = 0").first().text
    assert "zanzibar" not in text and "[term]" in text and "the owner" in text and "[email]" in text


def test_fingerprints_do_not_depend_on_the_offset():
    import random

    text = bytes(random.Random(8).choices(b"abcdefgh ", k=4000))
    a, b = phrase_fingerprint.sketches([text]), phrase_fingerprint.sketches([b"moved by some bytes " + text])
    assert phrase_fingerprint.likeness(a, b)[0] > 0.9 and (phrase_fingerprint.sketches([b"", b"zz", text])[2] == a[0]).all()


@pytest.mark.parametrize("group", [4096, 3])
def test_links_equal_brute_force(spark, group, monkeypatch):
    """Groups within the bound, and groups that are dealt again and again."""
    import random

    monkeypatch.setattr(simhash_pivots, "GROUP", group)
    random.seed(5)
    values = [random.getrandbits(64) - 2**63 for _ in range(60)] + [random.getrandbits(20) for _ in range(60)]
    flip = lambda v: v ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63))
    values = list(dict.fromkeys([*values, *(flip(v) for v in values for _ in range(4))]))
    from flowframe.llm.components import components

    edges = simhash_pivots.links(spark.createDataFrame([(v,) for v in values], "fp bigint"), 4)
    found = dict(tuple(r) for r in components(edges).collect())
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for v in values:
            for w in values:
                if root[v] > root[w] and bin((v ^ w) & (2**64 - 1)).count("1") <= 2:
                    root[v], changed = root[w], True
    assert {v: found.get(v, v) for v in values} == root


def test_every_pair_within_two_bits_survives_the_pivots():
    import random

    import numpy as np

    random.seed(9)
    values = [random.getrandbits(64) for _ in range(300)]
    values += [v ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for v in values]
    found = {(min(i, j), max(i, j)) for part in simhash_pivots.near_pairs(np.array(values, np.uint64), 2) for i, j in zip(*(x.tolist() for x in part))}
    assert found == {(i, j) for i in range(600) for j in range(i + 1, 600) if (values[i] ^ values[j]).bit_count() <= 2}


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a\r\nb", "x\r\n\r\nWARC/1.1"), (5, None, "x\r\n\r\nWARC/1.1"), (4, "u", None), (9, "u", "")]
    warc_revisit.write(spark.createDataFrame(pages, "page_id bigint, url string, html string"), f"file://{tmp_path}/w")
    found = {r.record_id.split(":")[2]: r for r in warc_revisit.read(spark, f"file://{tmp_path}/w").collect()}
    assert {k: r.record_type for k, r in found.items()} == {"1": "revisit", "5": "response", "4": "revisit", "9": "response"}
    assert bytes(found["5"].payload) == pages[1][2].encode() and found["1"].payload_bytes == len(pages[0][2])
    assert found["1"].digest == base64.b32encode(hashlib.sha1(pages[0][2].encode()).digest()).decode() and found["1"].refers_id == found["5"].record_id


def test_codec_equals_the_library():
    import sentencepiece

    model = sentencepiece_codec.default_model()
    ours, library = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in ["", " ", "  a  b ", "▁x y", "日本語 😀\x00 b", "𐍈" * 20, "a" * 3000, "\n\t x", "<s> <0x41>"]:
        ids, begin, end, _ = ours.encode(text)
        pieces = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == library.encode(text) and ours.decode(ids) == library.decode(ids.tolist())
        assert begin.tolist() == [p.begin for p in pieces] and end.tolist() == [p.end for p in pieces]


def test_character_map_equals_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    known = sentencepiece_codec.CharMap(proto.normalizer_spec.precompiled_charsmap)
    for text in ["ﬁne", "½", "ＡＢＣ", "ｶﾞ", "™"]:
        data, at, out = text.encode(), 0, b""
        while at < len(data):
            new, used = known.longest(data, at) or (data[at : at + 1], 1)
            out, at = out + new, at + used
        assert out.decode() == library.normalize(text).lstrip("▁")


def test_scores_equal_brute_force(spark):
    import collections
    import math

    rows = [(i, "a b a c" if i % 3 else "A x b") for i in range(40)]
    found = deleted_interpolation.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    count = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.lower().split(), None])
    n = sum(count.values())
    for r in found:
        words = [*rows[r.doc_id][1].lower().split(), None]
        base = sum(math.log10((count[w] + 1) / (n + len(count) + 1)) for w in words)
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(words), sum(count[w] > 0 for w in words)) and abs(r.base_score - base) < 1e-9 and r.score < 0


def test_tiles_of_a_reordered_passage(spark):
    item = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven twelve")], "item_id bigint, text string")
    rows = [(1, "zz seven eight nine ten eleven twelve yy One, two three four five six xx"), (2, "one two three four"), (3, "one two three four five")]
    assert [(r.doc_id, r.covered, r.longest) for r in string_tiling.matches(spark.createDataFrame(rows, "doc_id bigint, text string"), item).collect()] == [(1, 12, 6)]


@pytest.mark.parametrize("hot", [2000, 3])
def test_removal_equals_brute_force(spark, hot):
    import random

    random.seed(6)
    passage = "".join(random.choice("abcde fgh") for _ in range(600))
    rows = [(i, "".join(random.choice("abc d") for _ in range(random.randint(0, 200))) + passage[random.randint(0, 200) : random.randint(300, 600)]) for i in range(30)]
    rows += [(100, "a" * 3000), (101, "a" * 250), (102, None), (104, "x" * 99), (105, "ab" * 200), (200, rows[3][1])]
    seen, expected = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        expected[i] = (len(data), sum(gone), bytes(c for c, g in zip(data, gone) if not g))
    found = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), None, hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in found} == expected


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scored = [(r.predicted, labels[r.doc_id]) for r in QUERIES["op10_compression_quality"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in scored) / len(scored) > 0.9
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    judged = [(r.lang, docs[r.doc_id]) for r in QUERIES["op5_language_evidence"](spark, folder).collect() if r.doc_id is not None]
    assert sum(a == b for a, b in judged) / len(judged) > 0.98


def test_pipeline_keeps_columns_and_decisions(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == first.columns and 0 < after.count() <= docs.count()
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
