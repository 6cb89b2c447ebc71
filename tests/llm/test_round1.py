"""What the first round of advice found missing."""

import random


def test_pipeline_drops_near_copies_with_edits(spark, monkeypatch):
    """Every pair of 5-word likeness 0.8 or more is one group, compared with all pairs."""
    import corpus_pipeline
    from flowframe.llm import near_copies

    chance = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(chance.choices(words, k=40))
    rows = []
    for i in range(0, 200, 4):
        text = chance.choices(words, k=chance.choice([4, 9, 60, 300]))
        for j in range(4):
            edited = list(text)
            for _ in range(j * len(text) // 120 + j // 3):
                edited[chance.randrange(len(text))] = "edit"
            rows.append((i + j, " ".join(edited) + (f" {line}" if i % 3 else "")))
    rows += [(300, ""), (301, None), (None, rows[0][1])]

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}

    root, sets = {}, {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for group, block in ((4096, 8_000_000), (3, 8_000_000), (4096, 3000)):  # the last: components in several blocks
        monkeypatch.setattr(near_copies, "GROUP", group)
        monkeypatch.setattr(near_copies, "BLOCK_BYTES", block)
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect() if r.doc_id is not None} == root
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()}
    # the row without an id equals row 0, which has one
    assert kept == set(root.values()) and 50 < len(kept) < 150


def test_terms_beside_values_of_one_and_two_documents_go(spark):
    from flowframe.llm import disclosure

    rows = [(0, "the owner zanzibar the mail x.y@z.org and the end"), (1, "the owner kilwa the mail p.q@z.org and the end"), (2, "the owner kilwa the mail p.q@z.org and the end")]
    rows += [(10 + i, f"the quick mail and the owner end number {i} of the day") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = {r.doc_id: r.text for r in disclosure.sanitised(frame).collect()}
    assert all(texts[i] == "the owner [term] the mail [email] and the end" for i in range(3))
    assert all(texts[i] == t for i, t in rows[3:])
    assert {r.doc_id: r.spans.count("term") for r in disclosure.spans(frame).collect() if r.doc_id < 3} == {0: 1, 1: 1, 2: 1}
