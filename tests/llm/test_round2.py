"""Plain forms of what had none, and the odd inputs that the second round found untested."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard

from flowframe.llm import compression_quality, deleted_interpolation, disclosure, language_evidence, phrase_fingerprint, sentencepiece_codec, simhash_pivots, string_tiling, suffix_dedup, warc_revisit
from flowframe.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
M = 2**64


def frame_of(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    relation = connection.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert sorted(map(repr, (tuple(r[c] for c in relation.columns) for r in frame.collect()))) == sorted(map(repr, relation.fetchall()))


# op1


def test_repeated_rows_keep_their_terms(spark):
    """A row that stands there 40 times counts 40 times everywhere, so its term still tells all there is to tell."""
    row = (0, "the owner zanzibar the mail x.y@z.org and the end")
    others = [(10 + i, f"the quick mail and the owner end number {i} of the day") for i in range(200)]
    for times in (1, 40):
        found = disclosure.spans(frame_of(spark, [row] * times + others)).where("doc_id = 0").collect()
        assert len(found) == times and {r.spans for r in found} == {"term:10:18,email:28:37"}


def test_terms_are_found_in_the_given_tables(spark):
    found = QUERIES["op1_disclosure"](spark, FOLDER).collect()
    assert sum("term:" in r.spans for r in found) > 0


# op2


def mix(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 % M
    return x ^ (x >> 32)


def sketch_of(data):
    """One text's parsing, symbol by symbol."""
    key = 0x9E3779B97F4A7C15
    place = [mix((1000 + i) * key % M) | 1 for i in range(64)]
    bins = [0xFFFF] * 64

    def toss(a, b):
        k = ((a ^ b) & -(a ^ b)).bit_length() - 1
        return 2 * k + (a >> k & 1)

    symbols = list(data)
    names = [mix((b + 1) * key % M) for b in data]
    for level in range(1, phrase_fingerprint.LAST_LEVEL + 1):
        at = [i for i in range(len(symbols)) if i == 0 or symbols[i] != symbols[i - 1]]
        runs = [b - a for a, b in zip(at, [*at[1:], len(symbols)])]
        symbols, names = [symbols[i] for i in at], [names[i] for i in at]
        label = [symbols[0] & 1] + [toss(symbols[i], symbols[i - 1]) for i in range(1, len(symbols))]
        names = [mix((n + r * 0xA0761D6478BD642F) % M) if r > 1 else n for n, r in zip(names, runs)]
        for _ in range(3):
            label = [label[0] & 1] + [toss(label[i], label[i - 1]) for i in range(1, len(label))]
        starts = [0] + [i for i in range(2, len(label) - 1) if label[i - 1] < label[i] > label[i + 1]]
        names = [mix(sum(names[j] * place[j - a & 63] for j in range(a, b)) % M) for a, b in zip(starts, [*starts[1:], len(names)])]
        symbols = names
        if level >= phrase_fingerprint.FIRST_LEVEL:
            for n in names:
                own = mix((n + level) % M)
                bins[own >> 58] = min(bins[own >> 58], min(own >> 42 & 0xFFFF, 0xFFFE))
    return bins


def alike(a, b):
    used = [(x, y) for x, y in zip(a, b) if (x, y) != (0xFFFF, 0xFFFF)]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_op2_equals_plain_parsing(spark):
    random.seed(4)
    texts = ["", "a", "aaaaaaa", "ab" * 300, "é😀" * 40, *("".join(random.choice("abcd e") for _ in range(random.randrange(1, 900))) for _ in range(25))]
    rows = list(enumerate(texts)) + [(40, None)]
    found = {r.doc_id: r for r in phrase_fingerprint.edited_pairs(frame_of(spark, rows)).collect()}
    ids = sorted(dict(rows), reverse=True)
    of = {i: t or "" for i, t in rows}
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        half = len(of[i]) // 2
        edited = of[i][: len(of[i]) - half] + of[after][:half]
        own, other, following = (sketch_of(t.encode()) if t else [0xFFFF] * 64 for t in (of[i], edited, of[after]))
        text = lambda s: "".join(f"{x:04x}" for x in s)
        assert (found[i].fingerprint, found[i].edited_fingerprint) == (text(own), text(other))
        assert math.isclose(found[i].near_edited, alike(own, other)) and math.isclose(found[i].near_next, alike(own, following))


# op3


def test_rows_without_id_tie_nothing_together(spark):
    """Two groups that both have members without an id stay two; a name taken by another column changes nothing."""
    a, b = "one two three four five six", "alpha beta gamma delta epsilon"
    rows = [(5, a, "x"), (None, a, "y"), (None, b, "z"), (9, b, "x"), (None, "nobody else has this text", None), (3, "x" * 200_000, "")]
    found = simhash_pivots.near_duplicates(frame_of(spark, rows, "doc_id bigint, text string, fp string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == sorted([(5, 5), (None, 5), (None, 9), (9, 9), (None, None), (3, 3)], key=str)


# op4


def test_archives_hold_any_payload(spark, tmp_path):
    """Payloads made of line ends, repeated pages, null ids, and columns with the archives' own names."""
    random.seed(8)
    payload = lambda: "".join(random.choice(["\r", "\n", "\r\n", "\r\n\r\n", "a", "WARC/1.1", "é"]) for _ in range(random.randrange(30)))
    pages = [(i, "u", payload(), "clash", i) for i in range(120)] + [(7, "u", "same", "", 0), (7, "u", "same", "", 0), (9, "u", "same", "", 0), (None, "u", "same", "", 0), (500, None, "y" * 3_000_000, "", 0)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string, digest string, n int").repartition(3)
    warc_revisit.write(frame, f"file://{tmp_path}/w")
    found = warc_revisit.read(spark, f"file://{tmp_path}/w").collect()
    assert len(found) == len(pages)
    last = {}
    for i, _, html, *_ in pages:
        last[html] = max(last.get(html, -1), -1 if i is None else i)
    assert Counter((r.record_type, r.payload_bytes) for r in found) == Counter(("response" if i == last[h] else "revisit", len(h.encode())) for i, _, h, *_ in pages)
    assert {bytes(r.payload) for r in found if r.record_type == "response"} == {h.encode() for _, _, h, *_ in pages}
    import gzip

    for path in (tmp_path / "w" / "archives").glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"WARC-Date: 1970" not in data


# op5


def test_visible_text_in_linear_time():
    simple = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    random.seed(6)
    for _ in range(500):
        page = "".join(random.choice(["<", ">", "<!--", "-->", "<script>", "</script >", "<STYLE x>", "</style>", "a", " b ", "<p>", "</template>"]) for _ in range(random.randrange(14)))
        assert language_evidence.visible(page) == simple.sub(" ", page), page
    for part in ("<!--", "<script>", "<", "<html lang", "<style></script>"):
        began = time.perf_counter()
        language_evidence.visible(part * 300_000)
        language_evidence.declared(part * 300_000)
        assert time.perf_counter() - began < 10, part
    assert language_evidence.declared('<HTML class=x LANG="fr-CA"><html lang=en>') == "fr" and language_evidence.declared("<p lang=en>") is None


def test_op5_equals_plain_fusion(spark):
    random.seed(3)
    words = {"en": "the and of to in that house", "fr": "le la et de une maison que", "xx": "zu zo za ze zi zun zon"}
    say = lambda lang, n: " ".join(random.choice(words[lang].split()) for _ in range(n))
    docs = [(i, say(lang := random.choice(list(words)), random.randrange(1, 12)), lang, random.choice(["s1", "s2", None])) for i in range(90)]
    docs += [(200, None, "en", "s1"), (200, None, "en", "s1"), (None, "the house", "fr", None), (201, say("fr", 60_000), "fr", "s2")]
    pages = [(i, random.choice(["http://a.b.fr/x", "https://c.b.fr", "http://d.org", None, "http://["]), f"<html {random.choice(['', 'lang=fr', 'lang=zz'])}><script>{say('xx', 9)}</script>{say(random.choice(['en', 'fr']), 3)}") for i in range(40)]
    d = frame_of(spark, docs, "doc_id bigint, text string, lang string, source string").withColumn("own", language_evidence.F.lit("clash"))
    p = frame_of(spark, pages, "page_id bigint, url string, html string").withColumn("evidence", language_evidence.F.lit(1))
    model = language_evidence.fit(d)
    assert model.languages == ("en", "fr", "xx")

    def evidence(data):
        grams = [data[i : i + 3] for i in range(len(data) - 2)]
        at = [((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32) >> (32 - language_evidence.BITS) for g in grams]
        weight = min(len(grams), language_evidence.TEXT_WEIGHT) / max(len(grams), 1)
        return [float(model.table[at, k].astype(np.float64).sum() * weight) for k in range(3)]

    def softmax(x):
        w = [math.exp(v - max(x)) for v in x]
        return [v / sum(w) for v in w]

    rows = [(i, None, s, s, "" if s else None, None, evidence((t or "").encode())) for i, t, _, s in docs]
    for i, url, html in pages:
        host, domain, suffix = language_evidence._address(url)
        stated = re.search(r"lang=(\w+)", html)
        text = re.sub(r"<script>.*?</script>|<[^>]*>", " ", html)
        rows.append((None, i, host, domain, suffix, stated[1] if stated else None, evidence(text.encode())))
    own = [softmax(r[6]) for r in rows]
    sums = defaultdict(lambda: [0.0] * 3)
    for r, o in zip(rows, own):
        keys = [("all",)] + ([("host", r[2]), ("domain", r[3], r[4]), ("suffix", r[4])] if r[2] else []) + ([("said", r[5]), ("stated",)] if r[5] else [])
        for key in keys:
            sums[key] = [a + b for a, b in zip(sums[key], o)]
    expected = []
    for r, o in zip(rows, own):
        score = []
        for k in range(3):
            share = (sums["all",][k] - o[k] + 1) / (sum(sums["all",]) - 1 + 3)
            if r[2]:
                for key in (("suffix", r[4]), ("domain", r[3], r[4]), ("host", r[2])):
                    share = (max(sums[key][k] - o[k], 0) + language_evidence.SMOOTHING * share) / (max(sum(sums[key]) - 1, 0) + language_evidence.SMOOTHING)
            said = 0.0
            if r[5]:
                usual = sum(sums["said", r[5]]) / max(sum(sums["stated",]), 1)
                said = math.log((max(sums["said", r[5]][k] - o[k], 0) + usual) / (max(sums["stated",][k] - o[k], 0) + 1))
            score.append(r[6][k] + math.log(share) + said)
        p_ = softmax(score)
        expected.append((r[0], r[1], model.languages[p_.index(max(p_))], round(max(p_), 6)))
    found = [(r.doc_id, r.page_id, r.lang, round(r.confidence, 6)) for r in language_evidence.identify(d, p).collect()]
    assert Counter(found) == Counter(expected)


def test_op5_held_out_accuracy(spark):
    """Documents that taught nothing, as they are and as pages whose markup says nothing or the truth."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.doc_id in held}
    pages = spark.createDataFrame([(i, f"http://h{i % 9}.org/", f"<html{'' if i % 2 else f' lang={held[i]}'}><body>{t}</body>") for i, t in texts.items()], "page_id bigint, url string, html string")
    found = language_evidence.identify(docs, pages).collect()
    for column in ("doc_id", "page_id"):
        judged = [(r.lang, held[r[column]]) for r in found if r[column] in held]
        assert len(judged) == len(held) and sum(a == b for a, b in judged) / len(judged) > 0.98


# op6


def test_models_with_a_character_map_equal_the_library():
    """The given pieces behind other normalisers, whose maps the library compiled itself: ids, and every piece's source bytes."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    random.seed(2)
    texts = ["", "  ", " ﬁne  ½ ＡＢＣ ｶﾞ ™ ", "Ⅷ ㌔ x", "á é", "日本語 😀\x00 b", "ＦＵＬＬ　ＷＩＤＴＨ", "tab\tnew\nline", "ﷺ" * 3, "a " * 50 + " "]
    texts += ["".join(random.choice("aé ﬁ½Ａｶﾞ™　 x😀 \tⅧ") for _ in range(random.randrange(40))) for _ in range(150)]
    for rule in ("identity", "nfkc", "nmt_nfkc", "nfkc_cf"):
        for trim in (False, True):
            spec = sentencepiece_model_pb2.ModelProto()
            spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
            proto = sentencepiece_model_pb2.ModelProto()
            proto.ParseFromString(sentencepiece_codec.default_model())
            proto.normalizer_spec.name = rule
            proto.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
            proto.normalizer_spec.remove_extra_whitespaces = trim
            model = proto.SerializeToString()
            ours, library = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
            assert rule == "identity" or (ours.map and not ours.plain)
            for text in texts:
                ids, begin, end, _ = ours.encode(text)
                assert ids.tolist() == library.encode(text) and ours.decode(ids) == library.decode(ids.tolist()), (rule, trim, text)
                spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
                assert list(zip(begin.tolist(), end.tolist())) == spans, (rule, trim, text)


def test_tokenized_keeps_columns(spark):
    rows = [(1, "two words", "own"), (None, None, None), (1, "x" * 100_000, "own")]
    frame = frame_of(spark, rows, "doc_id bigint, text string, IDS string")
    found = sentencepiece_codec.tokenized(frame, sentencepiece_codec.default_model())
    assert found.columns == ["doc_id", "text", "IDS", "ids_", "begins", "ends", "decoded"]
    assert [(r.doc_id, r.text, r.IDS, r.decoded, len(r.ids_) == len(r.begins) == len(r.ends)) for r in found.collect()] == [(i, t, s, t or "", True) for i, t, s in rows]


# op7


def interpolated(rows):
    """(doc_id, score) of each row, token by token."""
    tokens = [[*(t or "").lower().split(), None] for _, t in rows]
    fold = [zlib.crc32(str(i).encode()) % 7 if i is not None else 2 for i, _ in rows]
    pairs = lambda words: list(zip(["<s>", *words], words))

    def counted(folds):
        one, two = Counter(), Counter()
        for f, words in zip(fold, tokens):
            if f in folds:
                one.update(words)
                two.update(pairs(words))
        return one, two, sum(one.values()), len(one)

    def parts(model, before, word):
        one, two, n, v = model
        context = one[None] if before == "<s>" else one[before]
        return min(context.bit_length(), deleted_interpolation.BUCKETS - 1), [two[before, word] / max(context, 1), one[word] / max(n, 1), 1 / (v + 1)]

    rest, whole = counted({0, 1, 4, 5, 6}), counted({0, 1, 3, 4, 5, 6})
    events = [parts(rest, *p) for f, words in zip(fold, tokens) if f == 3 for p in pairs(words)]
    weight = {b: [1 / 3] * 3 if b else [0, 0.5, 0.5] for b in range(deleted_interpolation.BUCKETS)}
    if not rest[2]:
        weight = {b: [0, 0, 1] for b in weight}
    for _ in range(deleted_interpolation.STEPS if rest[2] else 0):
        total = {b: [0.0] * 3 for b in weight}
        for b, p in events:
            held = [x * y for x, y in zip(weight[b], p)]
            total[b] = [t + h / sum(held) for t, h in zip(total[b], held)]
        everywhere = [sum(total[b][k] for b in total) + 1e-3 for k in range(3)]
        new = {}
        for b in weight:
            leaning = [total[b][k] + 3 * everywhere[k] / sum(everywhere) for k in range(3)]
            leaning[0] *= b > 0
            new[b] = [x / sum(leaning) for x in leaning]
        moved = max(abs(x - y) for b in weight for x, y in zip(weight[b], new[b]))
        weight = new
        if moved < deleted_interpolation.CLOSE:
            break

    def chance(before, word):
        b, p = parts(whole, before, word)
        return sum(x * y for x, y in zip(weight[b], p))

    return [sum(math.log10(chance(*p)) for p in pairs(words)) for words in tokens], chance, whole


def test_op7_equals_plain_interpolation(spark):
    random.seed(5)
    words = [f"w{int(random.paretovariate(0.7)) % 400}" for _ in range(900)]
    rows = [(i, " ".join(random.choices(words, k=random.randrange(40)))) for i in range(150)]
    rows += [(3, None), (3, ""), (None, "w1 w2 unheard"), (7, rows[7][1]), (7, rows[7][1]), (160, "A b\tC\x0bd " * 20_000)]
    expected, chance, whole = interpolated(rows)
    found = deleted_interpolation.scores(frame_of(spark, rows).withColumn("slice", disclosure.F.lit("clash"))).collect()
    close = lambda pairs: sorted((str(i), round(s, 6)) for i, s in pairs)
    assert close((r.doc_id, r.score) for r in found) == close((i, s) for (i, _), s in zip(rows, expected))
    for before in ("<s>", "w1", "w2", "unheard"):
        assert math.isclose(sum(chance(before, w) for w in whole[0]) + chance(before, "never seen"), 1, rel_tol=1e-9)
    alone = {r.doc_id: (r.n_seen_elsewhere, r.n_tokens) for r in found}
    assert alone[7][0] == alone[7][1] and alone[160][0] < alone[160][1]


def test_op7_without_training(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    found = deleted_interpolation.scores(frame_of(spark, [(i, "some words") for i in held] + [(None, "x")])).collect()
    assert len(found) == len(held) + 1 and all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in found)


# op8


def test_op8_odd_rows(spark):
    """Rows without an id are told apart, texts under one id are put together, periodic and very long texts end soon."""
    item = "one two three four five six seven"
    rows = [(None, f"a {item}"), (None, f"b {item} c"), (None, "clean"), (4, item), (4, "other text " * 9), (5, "same " * 200_000), (6, None), (7, "x1 " * 50_000 + item)]
    bench = frame_of(spark, [(1, item), (1, item), (2, "same " * 900), (None, item), (3, "too short")], "item_id bigint, text string")
    began = time.perf_counter()
    found = sorted(((r.doc_id, r.item_id, r.covered) for r in string_tiling.matches(frame_of(spark, rows).withColumn("row", disclosure.F.lit(1)), bench).collect()), key=str)
    assert found == sorted([(4, 1, 7), (7, 1, 7), (5, 2, 900), (None, 1, 7), (None, 1, 7)], key=str) and time.perf_counter() - began < 120


# op9


def test_suffix_order_and_common_prefixes():
    random.seed(3)
    for _ in range(150):
        pieces = [bytes(random.choice(b"ab\0"[: random.choice([1, 2, 3])]) for _ in range(random.randint(1, 50))) for _ in range(random.randint(1, 6))]
        pieces += pieces[:1] * random.randint(0, 1)
        suffixes = [(p[i:], k) for k, p in enumerate(pieces) for i in range(len(p))]
        expected = sorted(range(len(suffixes)), key=lambda x: ([b + 1000 for b in suffixes[x][0]] + [-suffixes[x][1]]))
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        order = suffix_dedup.suffix_array(data, size)
        shared = suffix_dedup.common_prefixes(data, size, order)
        assert order.tolist() == expected
        for a, b in zip(expected, expected[1:]):
            x, y = suffixes[a][0], suffixes[b][0]
            assert shared[b] == next((n for n, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))


@pytest.mark.parametrize("run", [2048, 7])
def test_op9_periodic_and_tied_rows(spark, run, monkeypatch):
    """Long runs are cut; rows under one id follow a hash of their texts, repeated rows are one document."""
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    random.seed(11)
    passage = "".join(random.choice("abcdefgh ") for _ in range(260))
    rows = [(9, passage + "first"), (9, "second" + passage), (9, passage + "first"), (12, "ab" * 3000), (13, "z" + "ab" * 200), (None, passage[30:200]), (14, "q" * 20_000)]
    frame = frame_of(spark, rows)
    order = {r.text: r.h for r in frame.select("text", suffix_dedup.F.xxhash64(suffix_dedup.F.col("text").cast("binary")).alias("h")).collect()}
    seen, expected = set(), {}
    for i, t in sorted(dict.fromkeys(rows), key=lambda r: (-(2**63) if r[0] is None else r[0], order[r[1]])):
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        expected[i, t] = (len(data), sum(gone), bytes(c for c, g in zip(data, gone) if not g))
    for hot in (2000, 3):
        found = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.deduplicated(frame, None, hot).collect())
        assert found == Counter((i, *expected[i, t]) for i, t in rows)


# op10


def test_op10_equals_plain_sizes(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = compression_quality.fit(docs, labels)
    found = {r.doc_id: r.score for r in QUERIES["op10_compression_quality"](spark, FOLDER).collect()}
    size = compression_quality.BLOCK_BYTES

    def shrunk(data, dictionary):
        tool = zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return sum(len(tool.compress(data[i : i + size])) for i in range(0, len(data), size))

    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        evidence = (shrunk(data, model.bad) - shrunk(data, model.good)) / len(data) if data else 0.0
        assert math.isclose(found[r.doc_id], 1 / (1 + math.exp(-max(min(model.slope * evidence + model.offset, 30), -30))), rel_tol=1e-9)


def test_op10_ranks_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scored = [(r.score, labels[r.doc_id]) for r in QUERIES["op10_compression_quality"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, q in scored if q == k] for k in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_scores_clash_with_no_column(spark):
    frame = frame_of(spark, [(1, "words " * 40, "own"), (1, "words " * 40, "own"), (2, "é" * 400_000, None)], "doc_id bigint, text string, Quality_Score string")
    scored = compression_quality.score(frame, compression_quality.Model(b"", b"", None, 0.0))
    assert scored.columns == ["doc_id", "text", "Quality_Score", "quality_score_"]
    assert [(r.Quality_Score, r.quality_score_) for r in scored.collect()] == [("own", 0.5), ("own", 0.5), (None, 0.5)]


# pipeline


def _small(spark, folder, docs, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Rows without an id leak or are copies like others; other columns, of whatever name, stay; clean rows stay whole."""
    import corpus_pipeline

    item = "one two three four five six seven"
    rows = [(None, f"this leaks {item}"), (1, "a clean text about nothing at all"), (None, "a clean text about nothing at all"), (2, "write to x.y@z.org now"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "kept", 7) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, quality_score string, ids int")
    _small(spark, str(tmp_path), docs, [(1, item)])
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == [*docs.columns, "ids_", "begins", "ends", "decoded"]
    kept = {r.doc_id: r for r in found.collect()}
    assert set(kept) == {1, 2, 3} and all((r.quality_score, r.ids) == ("kept", 7) for r in kept.values())
    assert kept[1].text == kept[1].decoded == rows[1][1] and "@" not in kept[2].text and kept[2].n_chars == len(kept[2].text)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    _small(spark, str(tmp_path), docs, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry_and_digest_of_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    tool = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    for r in QUERIES["op6_sentencepiece"](spark, FOLDER).collect():
        _, begin, end, _ = tool.encode(texts[r.doc_id] or "")
        assert r.spans_sha256 == hashlib.sha256(b"".join(int(x).to_bytes(8, "little") for x in (*begin, *end))).hexdigest()
