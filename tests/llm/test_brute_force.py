"""Whole queries against plain Python on whole small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash

from flowframe.llm import compression_quality, disclosure, language_evidence, sentencepiece_codec, simhash_pivots, string_tiling, suffix_dedup, warc_revisit
from flowframe.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in rows_of("documents")}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def by_id(frame, key="doc_id"):
    rows = frame.collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    """(start, kind's number, stop), sorted."""
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text) if valid(kind, m[0]))


def terms(text):
    import regex

    return [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{N}]+", text) if len(m[0]) >= disclosure.TERM_CHARS]


def all_spans(texts):
    """doc -> [(start, kind's number, stop, share)] by counting documents one by one."""
    base = {d: base_spans(t) for d, t in texts.items()}
    near, of_value, of_term = defaultdict(set), defaultdict(set), defaultdict(set)
    places = defaultdict(list)
    for d, t in texts.items():
        words = terms(t)
        for _, _, w in words:
            of_term[w].add(d)
        for a, k, b in base[d]:
            value = t[a:b].lower()
            of_value[value].add(d)
            for x, y, w in words:
                inside = (x >= a - disclosure.WINDOW and y <= a) or (x >= b and y <= b + disclosure.WINDOW)
                # a term that touches the window's edge inside the text may have been cut
                edge = (y <= a and x == a - disclosure.WINDOW) or (x >= b and y == b + disclosure.WINDOW)
                if inside and not (edge and 0 < x) and not any(x < q and p < y for p, _, q in base[d]):
                    near[value, w].add(d)
                    places[value, w].append((d, x, y))
    out = {d: {(a, k, b): 1.0 for a, k, b in spans} for d, spans in base.items()}
    for (value, w), both in near.items():
        ic = math.log2(len(texts) / len(of_value[value]))
        if len(both) >= disclosure.SUPPORT and ic > 0:
            share = math.log2(len(texts) * len(both) / (len(of_term[w]) * len(of_value[value]))) / ic
            if share >= disclosure.GENERALISE:
                for d, x, y in places[value, w]:
                    out[d][x, 4, y] = max(share, out[d].get((x, 4, y), 0))
    return {d: sorted((*k, s) for k, s in spans.items()) for d, spans in out.items()}


def listed(spans):
    return ",".join(f"{(*KINDS, 'term')[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def replaced(text, spans):
    import regex

    out, at = [], 0
    for a, k, b, share in spans:
        if a >= at:
            shape = regex.sub(r"\p{L}+", "x", regex.sub(r"\p{N}+", "0", text[a:b]))
            out += [text[at:a], f"[{list(KINDS)[k]}]" if k < 4 else "[term]" if share >= disclosure.REMOVE else shape]
        at = max(at, b)
    return "".join(out) + text[at:]


def fingerprint(text):
    words = split(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def groups(prints):
    """doc -> smallest doc of its component, over all pairs."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def covered(item, doc, least=5):
    """Words of the item in greedy tiles, and the longest tile, by trying every pair of places again and again."""
    free_item, free_doc, total, longest = [True] * len(item), [True] * len(doc), 0, 0
    at = defaultdict(list)
    for j in range(len(doc) - least + 1):
        at[tuple(doc[j : j + least])].append(j)
    while True:
        best = (0, 0, 0)
        for i in range(len(item) - least + 1):
            for j in at[tuple(item[i : i + least])]:
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_item[i + n] and free_doc[j + n]:
                    n += 1
                if n >= least and n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if not n:
            return total, longest
        free_item[i : i + n], free_doc[j : j + n] = [False] * n, [False] * n
        total, longest = total + n, max(longest, n)


def leaks(texts, items):
    """(doc, item) -> (words of the item, covered, longest)."""
    words = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in texts.items()}
    out = {}
    for i, t in items.items():
        item = re.findall(r"[^\W_]+", t.lower())
        for d, doc in words.items():
            n, longest = covered(item, doc)
            if n and n / len(item) >= string_tiling.COVERAGE:
                out[d, i] = (len(item), n, longest)
    return out


def test_op1_spans(spark, documents):
    expected = all_spans(documents)
    found = by_id(QUERIES["op1_disclosure"](spark, FOLDER))
    assert {d: r.spans for d, r in found.items()} == {d: listed(s) for d, s in expected.items()}
    for d, r in found.items():
        base = [s for s in expected[d] if s[1] < 4]
        assert r.base_sha256 == sha(listed(base)) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))


def test_op2_edited_texts(spark, documents):
    ids = sorted(documents, reverse=True)
    found = by_id(QUERIES["op2_phrase_fingerprint"](spark, FOLDER))
    assert set(found) == set(ids)
    for d, after in zip(ids, [*ids[1:], ids[0]]):
        half = len(documents[d]) // 2
        edited = documents[d][: len(documents[d]) - half] + documents[after][:half]
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(documents[d]), sha(edited)) and 0 <= r.near_edited <= 1
        assert (r.near_next == 1.0) == (r.fingerprint == found[after].fingerprint) and (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint)
    of = defaultdict(set)
    for d, t in documents.items():
        of[t].add(found[d].fingerprint)
    assert all(len(x) == 1 for x in of.values())


def test_op3_components(spark, documents):
    prints = {d: fingerprint(t) for d, t in documents.items()}
    found = by_id(QUERIES["op3_simhash_pivots"](spark, FOLDER))
    assert {d: r.fingerprint for d, r in found.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in found.items()} == groups(prints)


def test_op4_records(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in rows_of("pages")}
    last = {}
    for i in sorted(pages):
        last[pages[i]] = i
    found = by_id(QUERIES["op4_warc_revisit"](spark, FOLDER), "page_id")
    for i, data in pages.items():
        kept = last[data] == i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert tuple(found[i]) == (i, len(data), digest, "response" if kept else "revisit", None if kept else last[data])
    assert set(found) == set(pages)


def test_op6_tokens(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.default_model())
    found = by_id(QUERIES["op6_sentencepiece"](spark, FOLDER))
    for d, t in documents.items():
        ids = library.encode(t)
        assert (found[d].n_tokens, found[d].ids_sha256, found[d].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_op7_counts_and_gain(spark, documents):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in documents}
    tokens = {d: [*split(t), None] for d, t in documents.items()}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n = sum(count.values())
    found = by_id(QUERIES["op7_deleted_interpolation"](spark, FOLDER))
    for d, ws in tokens.items():
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + len(count) + 1)) for w in ws), rel_tol=1e-9)
    assert sum(r.score for r in found.values() if r.held_out) > sum(r.base_score for r in found.values() if r.held_out)


def test_op8_tiles(spark, documents):
    found = QUERIES["op8_string_tiling"](spark, FOLDER).collect()
    expected = leaks(documents, {r["item_id"]: r["text"] or "" for r in rows_of("benchmark")})
    assert {(r.doc_id, r.item_id): (r.item_words, r.covered, r.longest) for r in found} == expected and len(found) == len(expected)


def test_op9_removals(spark, documents):
    seen, expected = set(), {}
    for d in sorted(documents):
        data = documents[d].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        expected[d] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(data, gone) if not g)))
    found = by_id(QUERIES["op9_suffix_dedup"](spark, FOLDER))
    assert {d: tuple(r)[1:] for d, r in found.items()} == expected


def test_op10_columns(spark, documents):
    found = by_id(QUERIES["op10_compression_quality"](spark, FOLDER))
    assert set(found) == set(documents)
    for d, r in found.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def near_groups(texts):
    """doc -> smallest doc of its component, where texts of 5-word likeness 0.8 or more are linked, over all pairs."""
    sets = {}
    for d, t in texts.items():
        w = split(t)
        sets[d] = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_pipeline(spark, documents):
    """Every stage's decisions, in plain Python, on what its predecessor kept.

    The near-duplicate stage is on word shingles and no contract binds it, so five words and a likeness of 0.8 hold there,
    not op3's three words and two bits, which this test asked for at first.
    """
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = compression_quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    sizes = compression_quality.Sizes(model.good, model.bad)
    quality = lambda t: 1 / (1 + math.exp(-max(min(sizes.evidence(t.encode()) * model.slope + model.offset, 30), -30)))
    good = {d: t for d, t in documents.items() if quality(t) >= compression_quality.THRESHOLD}
    root = near_groups(good)
    single = {d: t for d, t in good.items() if root[d] == d}
    leaked = {d for d, _ in leaks(single, {r["item_id"]: r["text"] or "" for r in rows_of("benchmark")})}
    clean = {d: t for d, t in single.items() if d not in leaked}
    spans = all_spans(clean)
    library = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.default_model())
    found = by_id(corpus_pipeline.run(spark, FOLDER))
    assert len(good) < len(documents) and len(single) < len(good) and leaked and set(found) == set(clean)
    assert any(s[1] == 4 for x in spans.values() for s in x)
    for d, t in clean.items():
        text = replaced(t, spans[d])
        assert (found[d].text, found[d].ids, found[d].decoded) == (text, library.encode(text), library.decode(library.encode(text)))


def test_nulls_and_empty_tables(spark):
    """The defined results of single operators where a column is null or a table is empty."""
    docs = spark.createDataFrame([(1, None, "s", "en"), (None, "word " * 60, None, None), (2, "word " * 60, "s", "en"), (3, "", None, "fr")], "doc_id bigint, text string, source string, lang string")
    pages = spark.createDataFrame([(None, None, None), (1, "http://[", "<html lang=FR>x</html>")], "page_id bigint, url string, html string")
    judged = language_evidence.identify(docs, pages).collect()
    assert len(judged) == 6 and all(r.lang in ("en", "fr") and 0 < r.confidence <= 1 for r in judged)
    assert {r.lang for r in language_evidence.identify(docs.withColumn("lang", docs.lang.substr(9, 0)).where("false"), pages).collect()} == {None}
    assert language_evidence.identify(docs.limit(0), pages.limit(0)).count() == 0
    near = {(r.doc_id, r.component_id) for r in simhash_pivots.near_duplicates(docs).collect()}
    assert near == {(1, 1), (3, 1), (2, 2), (None, 2)}
    kept = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.deduplicated(docs).collect()}
    # a null id stands first; the text repeats itself after five bytes
    assert kept[2] == (300, b"") and kept[None] == (295, b"word ") and kept[1] == kept[3] == (0, b"")
    assert warc_revisit.revisits(pages.limit(0)).count() == 0
    only = compression_quality.score(docs, compression_quality.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"))).collect()
    assert [r.quality_score for r in only] == [0.5] * 4


def test_few_and_many_copies(spark):
    """Groups on both sides of the bound above which copies are met by broadcast."""
    rows = [(i, f"{'many' if i % 2 else f'pair {i // 4}'} copies of a text " + "of its own %d " % (1 if i % 2 else 10**6 + i // 4) * 8) for i in range(200)]
    texts = dict(rows)
    frame = suffix_dedup._prepared(spark.createDataFrame(rows, "doc_id bigint, text string"))
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    numbers = {r.number: r.doc for r in frame.select("doc", suffix_dedup._row_number("doc", "tid").alias("number")).collect()}
    found = sorted(numbers[r.number] for r in suffix_dedup._repeats(frame, 2).collect())
    assert found == [i for i in texts if first[texts[i]] < i]
    assert suffix_dedup._repeats(frame.limit(0), 2).count() == 0
