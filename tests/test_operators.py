import collections
import random

import pytest
from pyspark.sql import functions as F

from flowframe import sinks, sources
from flowframe.functions import bucket_of, java_hash, java_split, normalize_tagged, normalize_url, normalize_url_row, words_of_lines
from flowframe.operators import grouping, joins, mapreduce, order, partition, rows, sampling
from flowframe.plans import node, source
from flowframe.streaming import parquet_stream, run_to_end, streamed_distinct, streamed_limit, streamed_runs, streamed_scatter, streamed_word_count, text_stream, windowed_counts


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_java_split(spark):
    frame = spark.createDataFrame([("",), (" ",), ("a b ",), ("a  b",), (" a",)], "s string")
    assert [r[0] for r in frame.select(java_split(F.col("s"), " ")).collect()] == [[""], [], ["a", "b"], ["a", "", "b"], ["", "a"]]


def test_words_of_lines_equal_the_split_of_every_line(spark):
    random.seed(1)
    texts = ["".join(random.choice("ab  \n") for _ in range(random.randrange(12))) for _ in range(800)] + ["", " ", "\n", " \n", "\n ", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    whole = {r.i: r.w for r in frame.select("i", words_of_lines(F.col("s")).alias("w")).collect()}
    for i, text in enumerate(texts):
        expected = None
        if text is not None:
            expected = [w for line in text.split("\n") for w in ([""] if line == "" else line.rstrip(" ").split(" ") if line.strip(" ") else [])]
        assert whole[i] == expected, repr(text)


def test_word_count_of_lines(spark):
    words = sources.words_of(spark.createDataFrame([("a b a\nb\n",)], "value string"))
    assert got(grouping.word_count(words)) == [("", 1), ("a", 2), ("b", 2)]


def test_join_projection_and_visits(spark):
    joined = joins.merge_join(sources.userlog(spark), sources.websites(spark), "site", "site")
    assert joined.columns == ["site", "user", "ts", "site_r", "rank"]
    assert got(grouping.group_count(rows.project(joined, "user", "site", "rank"), "user")) == [(" usera", 2), (" userc", 1), (" userd", 1)]


def test_join_many_to_many_and_null_keys(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z"), (None, "n")], "k string, w string")
    assert sorted((r.v, r.w) for r in joins.merge_join(left, right, "k", "k").collect()) == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]


def test_tagged_join_of_three(spark):
    one = lambda k, v: spark.createDataFrame([(k, v)], "k string, v string")
    assert got(joins.tagged_join(one("a", "1"), [one("a", "x"), one("a", "p")])) == [("a", "1", "a", "p"), ("a", "1", "a", "x")]


@pytest.mark.parametrize("keys, expected", [("aab", [(1, "a", 2), (2, "b", 1)]), ("aaba", [(1, "a", 2), (2, "b", 1), (3, "a", 1)]), ("", [])])
def test_runs(spark, keys, expected):
    frame = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    assert got(grouping.run_group(frame, "k", ["i"])) == expected


def test_runs_across_ranges(spark):
    random.seed(3)
    keys = [random.choice(["x", "x", "x", None, "y"]) for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    runs = sum(i == 0 or keys[i] != keys[i - 1] for i in range(3000))
    found = grouping.run_group(frame, "k", ["i"]).collect()
    assert len(found) == runs and sorted(r.g for r in found) == list(range(1, runs + 1)) and sum(r.n for r in found) == 3000


def test_positions_are_a_sorted_permutation(spark):
    random.seed(4)
    values = [(random.randrange(50), i) for i in range(3000)]
    numbered = order.with_position(spark.createDataFrame(values, "v int, i int"), ["v", "i"]).collect()
    assert [(r.v, r.i) for r in sorted(numbered, key=lambda r: r.pos)] == sorted(values)


def test_positions_of_a_frequent_value_fill_several_ranges(spark):
    """A third of the rows share the sort key; equal rows and nulls have positions too."""
    rows_ = [(None if i % 50 == 0 else 7 if i % 3 == 0 else i, i % 1500) for i in range(3000)]
    frame = spark.createDataFrame(rows_, "v int, i int")
    numbered = order.with_position(frame, ["v"]).collect()
    key = lambda v: (v is not None, v or 0)
    assert sorted(r.pos for r in numbered) == list(range(1, 3001))
    assert [r.v for r in sorted(numbered, key=lambda r: r.pos)] == sorted((v for v, _ in rows_), key=key)
    dealt = order.ranged(frame, ["v"], 12).where("v = 7").select(order.RANGE).distinct().count()
    assert dealt > 1 and order.with_position(frame.limit(0), ["v"]).count() == 0


def test_urls(spark):
    frame = spark.createDataFrame([("http://www.a.com/x,u,t",), ("http://a.com/?r=https://www.b.com,u,t",), ("a.com,u,t,extra",)], "s string")
    assert [r[0] for r in frame.select(normalize_url_row(F.col("s"))).collect()] == ["a.com/x,u,t", "a.com/?r=b.com,u,t", "a.com,u,t"]
    assert frame.select(normalize_url(F.col("s"))).first()[0] == "a.com/x,u,t"
    assert rows.tag(frame, 3).select("tag", normalize_tagged(F.col("row"), "s").alias("row")).first()[1].s == "a.com/x,u,t"


def test_hash_ports(spark):
    words = {"Hello": 0, "World": 0, "!": 3, "text.com": 2, "texta.com": 3, "textb.com": 2, "textc.com": 1, "": 0}
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert dict(got(frame.select("w", bucket_of(java_hash(F.col("w")), 5)))) == words


def test_scatter_and_zip(spark):
    ten = spark.range(10).select(F.col("id").alias("i"))
    assert got(partition.scatter_port(ten, ["i"], 4)) == [(i, i % 4) for i in range(10)]
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "a int"), spark.createDataFrame([("a",), ("b",)], "b string")
    assert got(order.zip_by_position(a, b, ["a"], ["b"])) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("values, expected", [(range(1, 101), [26, 51, 76]), ([1, 2], []), ([10, 20, 30], [10, 20, 30]), ([], [])])
def test_range_bounds(spark, values, expected):
    assert sampling.range_bounds(spark.createDataFrame([(v,) for v in values], "v int"), "v", 4) == expected


def test_range_ports_send_ties_up(spark):
    frame = spark.createDataFrame([(v,) for v in (25, 26, 50, 51, 76, 100)], "v int")
    assert [p for _, p in got(partition.range_port(frame, "v", [26, 51, 76]))] == [0, 1, 1, 2, 3, 3]
    assert {p for _, p in got(partition.range_port(frame, "v", []))} == {0}


def test_limits_and_distinct(spark):
    frame = spark.createDataFrame([(v,) for v in (1, 2, 1, 3, 2)], "v int")
    assert got(grouping.distinct(frame)) == [(1,), (2,), (3,)] == got(grouping.distinct_per_partition(frame.coalesce(1)))
    assert order.limit(frame, 9).count() == 5 and order.limit_per_partition(frame.coalesce(1), 3).count() == 3
    assert got(order.merge_sorted([frame, frame], "v")) == sorted(got(frame) * 2)


def test_instances(spark):
    """Nulls equal nulls inside an instance; functions that give no port, or have no key, mean port 0."""
    frame = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (3, None)], "v int, s string").coalesce(1)
    assert sorted(grouping.distinct_per_partition(frame).collect(), key=str) == sorted(frame.distinct().collect(), key=str)
    keys = spark.createDataFrame([(k,) for k in ("b", "aaaa", None, "none", "aaaa")], "k string")
    dealt = partition.custom_partition(keys, lambda k: None if k == "none" else -len(k), "k", 3)
    assert sorted((r.k or "", r.port, r.at) for r in dealt.withColumn("at", F.spark_partition_id()).collect()) == [("", 0, 0), ("aaaa", 1, 1), ("aaaa", 1, 1), ("b", 1, 1), ("none", 0, 0)]


def test_sample_tee(spark):
    frame = spark.range(1000)
    every, some = sampling.sample_tee(frame, 1.0)
    assert every.count() == some.count() == 1000 and sampling.sample_tee(frame, -1)[1].count() == 0
    assert 40 < sampling.sample_tee(frame, 0.1)[1].count() < 180


def test_seeded_samples(spark):
    frame = spark.range(20000).select(F.col("id").alias("k"))
    sizes = [sampling.sample_by_key(frame, "k", 0.3, seed).count() for seed in (0, 7, 11)]
    assert all(5700 < n < 6300 for n in sizes)
    assert sampling.sample_by_key(frame, "k", 0.0).count() == 0 and sampling.sample_by_key(frame, "k", 1.0).count() == 20000


def test_map_reduce(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    found = mapreduce.map_reduce(frame, lambda r: [(r["k"], r["v"])], lambda k, vs: [(k, sum(vs))], "key string, value bigint", "key string, total bigint")
    assert got(found) == [("a", 4), ("b", 2)]
    assert got(mapreduce.map_aggregate(frame, F.col("k"), F.col("v"), F.sum)) == [("a", 4), ("b", 2)]


def test_reducers_get_combined_values(spark):
    frame = spark.range(0, 40000, 1, 8).select((F.col("id") % 5000).alias("k"))  # every map task has every key once
    found = mapreduce.map_reduce(
        frame,
        lambda r: [(r["k"], [r["k"], 1])],
        lambda k, vs: [(k, len(vs), sum(int(v[1]) for v in vs))],
        "key bigint, value array<bigint>",
        "key bigint, parts int, n bigint",
        combiner=lambda k, vs: [max(v[0] for v in vs), sum(v[1] for v in vs)],
        reducers=3,
    )
    assert found.rdd.getNumPartitions() == 3
    rows = found.collect()
    assert len(rows) == 5000 and {r.n for r in rows} == {8} and max(r.parts for r in rows) <= 2


@pytest.mark.parametrize("held", [0, 2000, mapreduce.HELD])
def test_combined_pairs_are_whole_however_few_are_held(spark, monkeypatch, held):
    monkeypatch.setattr(mapreduce, "HELD", held)
    keys = [None if i % 7 == 0 else f"k{i * i % 301}" for i in range(9000)]
    frame = spark.createDataFrame(list(zip(keys, range(9000))), "k string, v int").repartition(5)
    pair = collections.namedtuple("pair", "top n")

    def combiner(k, vs):
        assert {type(v).__name__ for v in vs} == {"pair"}  # never what a shuffle makes of them
        return pair(max(v.top for v in vs), sum(v.n for v in vs))

    def reducer(k, vs):
        return [(k, max(v["top"] for v in vs), sum(v["n"] for v in vs))]

    steps = {"pair_schema": "key string, value struct<top: bigint, n: bigint>", "result_schema": "key string, top bigint, n bigint"}
    expected = {k: (max(i for i in range(9000) if keys[i] == k), keys.count(k)) for k in set(keys)}
    for reducers in (None, 2):
        found = mapreduce.map_reduce(frame, lambda r: [(r["k"], pair(r["v"], 1))], reducer, combiner=combiner, reducers=reducers, **steps)
        assert {r.key: (r.top, r.n) for r in found.collect()} == expected
    nothing = mapreduce.map_reduce(frame.where("v < 0"), lambda r: [(r["k"], pair(r["v"], 1))], reducer, combiner=combiner, reducers=2, **steps)
    assert nothing.collect() == []


def test_missing_numeric_keys_are_combined(spark):
    frame = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("k"))
    found = mapreduce.map_reduce(frame, lambda r: [(r["k"], 1)], lambda k, vs: [(None if k != k else k, len(vs), sum(vs))], "key bigint, value bigint", "key bigint, parts int, n bigint", combiner=lambda k, vs: sum(vs), reducers=2)
    rows = found.collect()
    assert {r.key: r.n for r in rows} == {None: 2000, 0: 667, 1: 666, 2: 667} and max(r.parts for r in rows) <= 2


def test_sinks_and_sources(spark, tmp_path):
    frame = spark.createDataFrame([("x", "k", "v")], "a string, b string, c string")
    sinks.write_text(frame, str(tmp_path / "t"), "b", "c")
    assert sources.text_lines(spark, str(tmp_path / "t")).first()[0] == "k\tv"
    assert sources.tsv_file(spark, str(tmp_path / "t")).first()[0] == ["k", "v"]
    seen, stats = sinks.probe(spark.createDataFrame([(["a", "b", "c"],), (["d", "e"],)], "row array<string>"), "row", "p1")
    sinks.forget(seen)
    assert stats.get == {"rows": 2, "fields": 5}
    page = tmp_path / "page.html"
    page.write_text("Hello World\nHello")
    assert got(grouping.word_count(sources.web_words(spark, page.as_uri()))) == [("Hello", 2), ("World", 1)]


def test_printed_and_mapped(spark, tmp_path, capsys):
    frame = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int").coalesce(1)
    sinks.print_rows(frame, 5, 3)
    assert capsys.readouterr().out.splitlines() == ["received on input 3: (a,1)", "received on input 3: (null,2)"]
    assert [r.line for r in sinks.probe_rows(frame.select(F.array("k", "k").alias("row")), "row").collect()] == ["a,a", "null,null"]
    sinks.write_pairs(frame, "json", str(tmp_path / "j"))
    twice = lambda f: f.where("k is not null").select(F.explode(F.array("v", F.col("v") + 1)).alias("v"))
    assert got(sources.mapped(spark, "json", str(tmp_path / "j"), twice)) == [(1,), (2,)]
    done = mapreduce.job(frame, str(tmp_path / "o"), lambda r: [(r["k"] or "none", r["v"])], lambda k, vs: [(k, max(vs))], "key string, value bigint", "key string, top bigint", kind="orc", reducers=3)
    assert got(done) == [("a", 1), ("none", 2)]
    (tmp_path / "lines.txt").write_bytes(b"a b\r\nc\rd\n")
    assert [r.word for r in sources.word_file(spark, str(tmp_path / "lines.txt")).collect()] == ["a", "b", "c", "d"]


def test_connectors():
    many = lambda n: node(lambda f: f, "n") ^ n
    assert len((many(2) >> many(3)).edges) == 6 and len(many(2).zip(many(5)).edges) == 5 and len(many(5).zip(many(2)).edges) == 5
    assert len(many(3).nodes) == 3 and not many(3).edges
    a, b, c = node(lambda f: f, "a"), node(lambda f: f, "b"), node(lambda f: f, "c")
    both = (a >> b) | (a >> c)
    assert [n.name for n in both.nodes] == ["a", "b", "c"] and both.inputs == a.nodes and set(both.outputs) == {*b.nodes, *c.nodes}
    assert both.cumulated_out_degree(a.nodes[0]) == 2 and both.ancestors(b.nodes[0]) == list(a.nodes) and "n0 -> n1" in both.to_dot()
    with pytest.raises(ValueError):
        (a >> b).union(b >> a)


def test_flow_runs(spark):
    words = source(lambda: sources.hello_words(spark), "words")
    out = ((words ^ 2) >> node(lambda f: grouping.word_count(f), "count")).compile()[0]
    assert got(out) == [("!", 2), ("Hello", 2), ("World", 2)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a b a\nb\n")
    lines = spark.readStream.text(str(tmp_path / "in"))
    run_to_end(streamed_word_count(lines), "counted", "complete", str(tmp_path / "c1"))
    assert got(spark.table("counted")) == [("a", 2), ("b", 2)]
    run_to_end(streamed_distinct(sources.words_of(lines), ["word"]), "distinct_words", "append", str(tmp_path / "c2"))
    assert got(spark.table("distinct_words")) == [("a",), ("b",)]


def test_streams_of_files_and_windows(spark, tmp_path):
    frame = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id % 3) ts, id % 2 k FROM range(12)")
    frame.write.parquet(str(tmp_path / "p"))
    counted = windowed_counts(parquet_stream(spark, str(tmp_path / "p"), frame.schema, 1), "ts", "1 minute", "k", "0 seconds")
    run_to_end(counted, "windowed", "complete", str(tmp_path / "c1"))
    assert sorted((r.window.start.minute, r.k, r.n) for r in spark.table("windowed").collect()) == [(m, k, 2) for m in range(3) for k in range(2)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("".join(f"{i}\n" for i in range(20)))
    run_to_end(streamed_limit(text_stream(spark, str(tmp_path / "t")), 7), "limited", "append", str(tmp_path / "c2"))
    assert spark.table("limited").count() == 7


def test_streams_with_state(spark, tmp_path):
    """Counters and open runs live on from one file, and so one batch, to the next."""
    keys = list("aabbbcaaab") + [None, None, "a"]
    for part in range(3):
        rows_ = [(f"s{j}", i, k) for j in range(2) for i, k in enumerate(keys) if i * 3 // len(keys) == part]
        spark.createDataFrame(rows_, "b string, i int, k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: parquet_stream(spark, str(tmp_path / "in"), "b string, i int, k string", 1)
    run_to_end(streamed_scatter(stream(), "b", "i", 4), "scattered", "append", str(tmp_path / "c1"))
    found = spark.table("scattered").collect()
    assert len(found) == 2 * len(keys) and all(sorted(r.port for r in found if r.b == b) == sorted(i % 4 for i in range(len(keys))) for b in ("s0", "s1"))
    run_to_end(streamed_runs(stream(), "b", "k", "i"), "runs", "update", str(tmp_path / "c2"))
    last = {}
    for r in spark.table("runs").collect():
        last[r.by, r.g] = max(last.get((r.by, r.g), (r.k, 0)), (r.k, r.n), key=lambda x: x[1])
    assert last == {(b, g): run for b in ("s0", "s1") for g, run in enumerate([("a", 2), ("b", 3), ("c", 1), ("a", 3), ("b", 1), (None, 2), ("a", 1)], 1)}
