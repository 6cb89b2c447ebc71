"""The registered queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, sources
from .functions import java_hash, normalize_tagged, normalize_url, normalize_url_row
from .operators import grouping, joins, mapreduce, order, partition, rows, sampling
from .plans import node, source
from .session import work_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_t = sources.table


_WORDS = """SELECT unnest(CASE WHEN l='' THEN [''] WHEN rtrim(l,' ')='' THEN [] ELSE string_split(rtrim(l,' '),' ') END) word
  FROM (SELECT unnest(string_split(text,chr(10))) l FROM documents)"""


@_query(f"SELECT word, count(*) n FROM ({_WORDS}) GROUP BY word")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return grouping.word_count(sources.words_of(_t(spark, d, "documents"), "text"))


@_query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def text_tsv(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "customer").select(F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    f = sources.tsv_fields(lines).select("fields")
    return f.select(F.col("fields")[0].cast("bigint").alias("c_custkey"), F.col("fields")[1].alias("c_name"), F.col("fields")[2].alias("c_mktsegment"))


@_query("""SELECT * FROM (VALUES ('text.com',' usera',' 201101021457',' 20000'),('texta.com',' usera',' 201101021458',' 30000'),
 ('textb.com',' userc',' 201101021459',' 40000'),('textc.com',' userd',' 201101021500',' 50000')) v(site, "user", ts, "rank")""")
def constant_source(spark: SparkSession, d: str) -> DataFrame:
    return sources.userlog(spark).join(sources.websites(spark), "site")


@_query("SELECT * FROM (VALUES ('Hello'),('World'),('!')) v(word)")
def hello_words(spark: SparkSession, d: str) -> DataFrame:
    return sources.hello_words(spark)


@_query("SELECT * FROM nation")
def pass_all(spark: SparkSession, d: str) -> DataFrame:
    return rows.pass_(_t(spark, d, "nation"))


@_query("SELECT * FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def filter_orders(spark: SparkSession, d: str) -> DataFrame:
    return rows.keep(_t(spark, d, "orders"), "o_totalprice > 250000 AND o_orderstatus = 'F'")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_sorted(spark: SparkSession, d: str) -> DataFrame:
    return order.top_k(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


@_query("""SELECT o_orderkey, p FROM (SELECT o_orderkey, o_custkey % 4 p,
 row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) rn FROM orders) x WHERE rn <= 10""")
def limit_per_partition(spark: SparkSession, d: str) -> DataFrame:
    ports = partition.port(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey"), 4, "p")
    return order.limit_per_key(ports, F.col("p"), ["o_orderkey"], 10).select("o_orderkey", "p")


@_query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return grouping.distinct(_t(spark, d, "part").select("p_brand", "p_type"))


@_query("SELECT abs(o_custkey) % 5 p, count(*) n, count(DISTINCT o_custkey) d FROM orders GROUP BY 1")
def hash_bucket(spark: SparkSession, d: str) -> DataFrame:
    ports = partition.port(_t(spark, d, "orders").select("o_custkey"), F.col("o_custkey"), 5, "p")
    return ports.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("d"))


@_query("""SELECT c_custkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 5 p FROM (SELECT c_custkey,
 list_reduce(list_transform(string_split(c_name,''), lambda c: cast(unicode(c) AS bigint)), lambda a, c: (a*31+c) % 4294967296, 0::bigint) h FROM customer)""")
def hash_bucket_string(spark: SparkSession, d: str) -> DataFrame:
    return partition.port(_t(spark, d, "customer"), java_hash(F.col("c_name")), 5, "p").select("c_custkey", "p")


@_query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey)-1) % 4 p FROM orders")
def scatter_bucket(spark: SparkSession, d: str) -> DataFrame:
    return partition.scatter_port(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 4, "p").select("o_orderkey", "p")


@_query("SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1")
def hash_exchange(spark: SparkSession, d: str) -> DataFrame:
    dealt = partition.hash_partition(_t(spark, d, "customer").select("c_nationkey"), 8, "c_nationkey")
    return dealt.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) pos FROM orders")
def sort_global(spark: SparkSession, d: str) -> DataFrame:
    return order.with_position(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@_query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) pos FROM orders")
def sort_local(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("pos"))


@_query("""SELECT k, src, row_number() OVER (ORDER BY k, src) pos FROM
 (SELECT c_custkey k, 0 src FROM customer UNION ALL SELECT s_suppkey k, 1 src FROM supplier) x""")
def merge_sorted(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).alias("src"))
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(1).alias("src"))
    return order.with_position(a.unionByName(b), ["k", "src"])


@_query("SELECT o_orderkey FROM orders WHERE (o_orderkey*2654435761)%4294967296 < 429496729")
def sample_tee(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_by_key(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.1)


@_query("""SELECT 0 port, o_orderkey FROM orders UNION ALL
 SELECT 1, o_orderkey FROM orders WHERE ((o_orderkey + 7)*2654435761)%4294967296 < 1288490188""")
def sample_bernoulli(spark: SparkSession, d: str) -> DataFrame:
    """Both ports of the tee: all rows, and a seeded sample."""
    orders = _t(spark, d, "orders").select("o_orderkey")
    some = sampling.sample_by_key(orders, "o_orderkey", 0.3, 7)
    return orders.select(F.lit(0).alias("port"), "o_orderkey").unionAll(some.select(F.lit(1), "o_orderkey"))


@_query("""SELECT k, v FROM (SELECT o_totalprice v, row_number() OVER (ORDER BY o_totalprice)-1 i, count(*) OVER () c FROM orders)
 JOIN (SELECT cast(unnest(range(1,8)) AS int) k) ON i = (c*k)//8""")
def range_bounds(spark: SparkSession, d: str) -> DataFrame:
    bounds = sampling.range_bounds(_t(spark, d, "orders").select("o_totalprice"), "o_totalprice", 8)
    return spark.createDataFrame(list(enumerate(bounds, 1)), "k int, v double")


_BOUNDS = """WITH t AS (SELECT o_orderkey, o_totalprice v FROM orders),
 i AS (SELECT v, row_number() OVER (ORDER BY v)-1 i, count(*) OVER () c FROM t),
 b AS (SELECT list(v ORDER BY v) s FROM i WHERE i IN (c*1//4, c*2//4, c*3//4))"""


@_query(f"{_BOUNDS} SELECT cast(len(list_filter(s, lambda x: x <= v)) AS int) p, count(*) n, min(v) lo, max(v) hi FROM t, b GROUP BY 1")
def range_partition(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "orders").select(F.col("o_totalprice").alias("v"))
    dealt = partition.range_port(t, "v", sampling.range_bounds(t, "v", 4), "p")
    return dealt.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@_query(f"""{_BOUNDS}, q AS (SELECT o_orderkey, v, cast(len(list_filter(s, lambda x: x <= v)) AS int) port FROM t, b)
 SELECT o_orderkey, v, port, row_number() OVER (PARTITION BY port ORDER BY v, o_orderkey) pos FROM q""")
def sample_sort(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return sampling.sample_sort(t, "v", ["o_orderkey"], 4)


_UNION = """SELECT 0 tag, cast(n_nationkey AS bigint) k, n_name v FROM nation
 UNION ALL SELECT 1 tag, cast(c_nationkey AS bigint) k, c_name v FROM customer
 UNION ALL SELECT 2 tag, cast(s_nationkey AS bigint) k, s_name v FROM supplier"""


def _three(spark: SparkSession, d: str) -> list[DataFrame]:
    names = (("nation", "n"), ("customer", "c"), ("supplier", "s"))
    return [_t(spark, d, t).select(F.col(f"{p}_nationkey").cast("bigint").alias("k"), F.col(f"{p}_name").alias("v")) for t, p in names]


@_query(_UNION)
def tag_union(spark: SparkSession, d: str) -> DataFrame:
    tagged = [rows.tag(f, i) for i, f in enumerate(_three(spark, d))]
    return rows.fan_in(*tagged).select("tag", "row.k", "row.v")


@_query("SELECT * FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_join(spark: SparkSession, d: str) -> DataFrame:
    """The planner picks the strategy: a checked-size broadcast or a sort-merge join."""
    return joins.merge_join(_t(spark, d, "orders"), _t(spark, d, "customer"), "o_custkey", "c_custkey")


@_query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_join_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The sort-merge strategy by name."""
    return joins.merge_join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), _t(spark, d, "customer").select("c_custkey"), "o_custkey", "c_custkey", merge=True).drop("o_custkey")


@_query(f"WITH u AS ({_UNION}) SELECT l.k lk, l.v lv, r.k rk, r.v rv FROM u l JOIN u r ON l.k = r.k AND l.tag = 0 AND r.tag <> 0")
def merge_join_multi(spark: SparkSession, d: str) -> DataFrame:
    first, *others = _three(spark, d)
    return joins.tagged_join(first, others)


@_query("SELECT cast(user_id AS varchar) k, count(*) n FROM events GROUP BY 1")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return grouping.group_count(_t(spark, d, "events").select("user_id"), "user_id")


@_query("SELECT o_custkey k, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey) vs FROM orders GROUP BY 1")
def group_collect(spark: SparkSession, d: str) -> DataFrame:
    return grouping.group_collect(_t(spark, d, "orders"), "o_custkey", "o_orderkey").select("k", F.array_join("values", ",").alias("vs"))


_RUNS = """SELECT g, max(event_type) k, count(*) n FROM (SELECT *, cast(sum(f) OVER (ORDER BY event_id) AS bigint) g FROM (
 SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END f FROM events)) GROUP BY g"""


@_query(_RUNS)
def run_group(spark: SparkSession, d: str) -> DataFrame:
    return grouping.run_group(_t(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"])


@_query("""SELECT g, max(event_type) k, string_agg(event_id::varchar, ',' ORDER BY event_id) vs FROM (SELECT *, cast(sum(f) OVER (ORDER BY event_id) AS bigint) g FROM (
 SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END f FROM events)) GROUP BY g""")
def run_collect(spark: SparkSession, d: str) -> DataFrame:
    runs = grouping.run_collect(_t(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", ["event_id"])
    return runs.select("g", "k", F.array_join("values", ",").alias("vs"))


@_query("SELECT o_custkey k, count(*) n FROM orders GROUP BY 1")
def count_fields(spark: SparkSession, d: str) -> DataFrame:
    return rows.count_fields(grouping.group_collect(_t(spark, d, "orders"), "o_custkey", "o_orderkey"), "k", "values")


@_query("SELECT e.user_id, c.c_name, e.value FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def project_reorder(spark: SparkSession, d: str) -> DataFrame:
    joined = joins.merge_join(_t(spark, d, "events"), _t(spark, d, "customer"), "user_id", "c_custkey")
    return rows.project(joined, "user_id", "c_name", "value")


_CLEAN = "replace(replace(replace({},'http://',''),'https://',''),'www.','')"


@_query(f"SELECT page_id, {_CLEAN.format('url')} u FROM pages")
def normalize_urls(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", normalize_url(F.col("url")).alias("u"))


@_query(f"""SELECT page_id, array_to_string([{_CLEAN.format('f[1]')}, f[2], f[3]], ',') r FROM
 (SELECT page_id, string_split(url || ',' || page_id || ',x,extra', ',') f FROM pages)""")
def normalize_url_rows(spark: SparkSession, d: str) -> DataFrame:
    csv = _t(spark, d, "pages").select("page_id", F.concat_ws(",", "url", "page_id", F.lit("x"), F.lit("extra")).alias("row"))
    return csv.select("page_id", normalize_url_row(F.col("row")).alias("r"))


@_query(f"SELECT 0 tag, page_id, {_CLEAN.format('url')} url FROM pages")
def normalize_url_tagged(spark: SparkSession, d: str) -> DataFrame:
    """The tagged form: the URL inside the row goes, tag and other fields stay."""
    tagged = rows.tag(_t(spark, d, "pages").select("url", "page_id"), 0)
    return tagged.select("tag", normalize_tagged(F.col("row"), "url").alias("row")).select("tag", "row.page_id", "row.url")


@_query("SELECT c_name, count(*) n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1")
def url_visits(spark: SparkSession, d: str) -> DataFrame:
    return project_reorder(spark, d).groupBy("c_name").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT * FROM (VALUES (' usera', cast(2 AS bigint)), (' userc', 1), (' userd', 1)) v(k, n)""")
def site_visits(spark: SparkSession, d: str) -> DataFrame:
    """The demonstration pipeline: clean URLs, join on the site, project, count by user."""
    log = sources.userlog(spark).withColumn("site", normalize_url(F.col("site")))
    joined = joins.merge_join(log, sources.websites(spark), "site", "site")
    return grouping.group_count(rows.project(joined, "user", "site", "rank"), "user")


_REVENUE = "SELECT l_partkey k, cast(sum(cast(round(l_extendedprice*100) AS bigint)) AS bigint) cents FROM lineitem GROUP BY 1"


@_query(_REVENUE)
def mapreduce_revenue(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return mapreduce.map_aggregate(_t(spark, d, "lineitem"), F.col("l_partkey"), cents, F.sum, "cents").withColumnRenamed("key", "k")


@_query("SELECT l_returnflag AS key, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS total FROM lineitem GROUP BY 1")
def mapreduce_generic(spark: SparkSession, d: str) -> DataFrame:
    return mapreduce.map_reduce(
        _t(spark, d, "lineitem").select("l_returnflag", "l_quantity"),
        lambda r: [(r["l_returnflag"], int(r["l_quantity"]))],
        lambda k, vs: [(k, sum(vs))],
        "key string, value bigint",
        "key string, total bigint",
        combiner=lambda k, vs: sum(vs),
    )


@_query("SELECT c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def composite(spark: SparkSession, d: str) -> DataFrame:
    inner = node(lambda f: f.where("c_acctbal > 0"), "positive").then(node(lambda f: f.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), "count"))
    return _t(spark, d, "customer").transform(inner.as_transform())


@_query("SELECT count(*) n, cast(sum(len(string_split(c_name,'#'))) AS bigint) fields FROM customer")
def probe_stats(spark: SparkSession, d: str) -> DataFrame:
    seen, observation = sinks.probe(_t(spark, d, "customer").select(F.split("c_name", "#").alias("row")), "row", f"probe {uuid.uuid4()}")
    sinks.forget(seen)
    found = observation.get
    return spark.createDataFrame([(found["rows"], found["fields"])], "n bigint, fields bigint")


@_query("""SELECT k, count(*) n FROM (SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey k FROM supplier
 UNION ALL SELECT n_nationkey k FROM nation) x GROUP BY k""")
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    def reads(table: str, column: str):
        return source(lambda: _t(spark, d, table).select(F.col(column).alias("k")), table)

    three = reads("customer", "c_nationkey") | reads("supplier", "s_nationkey") | reads("nation", "n_nationkey")
    return (three >> node(lambda f: f.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "count")).compile()[0]


@_query("""SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) r FROM customer) a
 JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) r FROM supplier) b ON a.r = b.r""")
def synchronous_zip(spark: SparkSession, d: str) -> DataFrame:
    return order.zip_by_position(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "supplier").select("s_suppkey"), ["c_custkey"], ["s_suppkey"])


@_query("SELECT cast(c_custkey AS varchar) AS key, c_name AS value FROM customer")
def text_sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark)
    sinks.write_text(_t(spark, d, "customer"), path, "c_custkey", "c_name")
    return sources.tsv_file(spark, path).select(F.col("fields")[0].alias("key"), F.col("fields")[1].alias("value"))


@_query("""SELECT abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 5 p, count(*) n FROM (SELECT
 list_reduce(list_transform(string_split(r_name,''), lambda c: cast(unicode(c) AS bigint)), lambda a, c: (a*31+c) % 4294967296, 0::bigint) h FROM region) GROUP BY 1""")
def custom_bucket(spark: SparkSession, d: str) -> DataFrame:
    return partition.port(_t(spark, d, "region"), java_hash(F.col("r_name")), 5, "p").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT word, count(*) n FROM (SELECT unnest(string_split({_CLEAN.format('url')}, '/')) word FROM pages) GROUP BY 1")
def url_words(spark: SparkSession, d: str) -> DataFrame:
    return grouping.word_count(_t(spark, d, "pages").select(F.explode(F.split(normalize_url(F.col("url")), "/")).alias("word")))


# sources and sinks that write files first


@_query(f"SELECT word, count(*) n FROM ({_WORDS}) GROUP BY word")
def word_file_count(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as files of lines; Spark splits the files, every line gives its words."""
    path = work_dir(spark)
    _t(spark, d, "documents").select(F.col("text").alias("value")).where("value is not null").write.option("lineSep", "\n").text(path)
    return grouping.word_count(sources.word_file(spark, path, "\n"))


@_query("SELECT o_custkey % 10 k, o_orderkey v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey % 10, -o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def mapped_source(spark: SparkSession, d: str) -> DataFrame:
    """Any format with a mapper of one record to several pairs: here JSON lines and an array of structs."""
    path = work_dir(spark)
    sinks.write_pairs(_t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), "json", path)
    k, v = (F.col("o_custkey") % 10).alias("k"), F.col("o_orderkey")
    return sources.mapped(spark, "json", path, F.array(F.struct(k, v.alias("v")), F.struct(k, (-v).alias("v"))))


@_query("SELECT n_nationkey, n_name FROM nation")
def pairs_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Any format that Spark writes."""
    path = work_dir(spark)
    sinks.write_pairs(_t(spark, d, "nation").select("n_nationkey", "n_name"), "csv", path, sep=";")
    return spark.read.schema("n_nationkey int, n_name string").csv(path, sep=";")


@_query("SELECT 2 port, '(' || n_nationkey || ',' || n_name || ')' AS value FROM nation")
def port_sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The writer's other form: the input's port number is the key."""
    path = work_dir(spark)
    sinks.write_rows(_t(spark, d, "nation").select("n_nationkey", "n_name"), path, 2)
    return sources.tsv_file(spark, path).select(F.col("fields")[0].cast("int").alias("port"), F.col("fields")[1].alias("value"))


@_query("SELECT 'received on input 1: (' || r_regionkey || ',' || r_name || ')' line FROM region")
def printed_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.printed(_t(spark, d, "region").select("r_regionkey", "r_name"), 1)


@_query("SELECT array_to_string(string_split(c_name, '#'), ',') line FROM customer ORDER BY c_custkey LIMIT 7")
def probe_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a probe prints; how many is the probe's own argument."""
    arrays = _t(spark, d, "customer").orderBy("c_custkey").select(F.split("c_name", "#").alias("row"))
    return sinks.probe_rows(arrays, "row", 7)


@_query("SELECT * FROM (VALUES ('one', cast(2 AS bigint)), ('two', 1), ('', 1)) v(word, n)")
def web_word_count(spark: SparkSession, d: str) -> DataFrame:
    """Pages fetched by URL, one task each; data: URLs stand for a server."""
    return grouping.word_count(sources.web_words(spark, "data:text/plain;charset=utf-8,one%20two", "data:text/plain;charset=utf-8,one%20%0A"))


# ports and instances


@_query("""SELECT s_suppkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 4 port FROM (SELECT s_suppkey,
 list_reduce(list_transform(string_split(cast(s_nationkey AS varchar),''), lambda c: cast(unicode(c) AS bigint)), lambda a, c: (a*31+c) % 4294967296, 0::bigint) h FROM supplier)""")
def tagged_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Tagged rows by the string hash of their key."""
    tagged = rows.tag(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey"), 1)
    return partition.port_on_key(tagged, 4).select("row.s_suppkey", "port")


@_query("SELECT o_orderkey, cast((o_custkey // 7) % 4 AS int) port, true there FROM orders")
def function_partition(spark: SparkSession, d: str) -> DataFrame:
    """Any Python function as partitioner; the partition that a row stands in is its port."""
    dealt = partition.custom_partition(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), lambda k: k // 7, "o_custkey", 4)
    return dealt.select("o_orderkey", "port", (F.spark_partition_id() == F.col("port")).alias("there"))


def _instances(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Orders dealt to four instances by customer."""
    return partition.to_ports(_t(spark, d, "orders").select(*columns, (F.col("o_custkey") % 4).cast("int").alias("p")), 4, "p")


@_query("SELECT o_orderkey, cast(o_custkey % 4 AS int) p, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_totalprice, o_orderkey) pos FROM orders")
def sort_instances(spark: SparkSession, d: str) -> DataFrame:
    """Every instance sorts its own rows."""
    ordered = order.sort(_instances(spark, d, "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", per_partition=True)
    return ordered.select("o_orderkey", "p", (order.place_in_partition() + 1).alias("pos"))


@_query("""SELECT o_orderkey, cast(p AS int) p FROM (SELECT o_orderkey, o_custkey % 4 p,
 row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) rn FROM orders) x WHERE rn <= 10""")
def limit_instances(spark: SparkSession, d: str) -> DataFrame:
    """Every instance passes its first rows; how many is the operator's own argument."""
    return order.limit_per_partition(_instances(spark, d, "o_orderkey").sortWithinPartitions("o_orderkey"), 10)


@_query("SELECT DISTINCT o_orderpriority, cast(o_custkey % 4 AS int) p FROM orders")
def distinct_instances(spark: SparkSession, d: str) -> DataFrame:
    """Every instance passes a row's first occurrence."""
    return grouping.distinct_per_partition(_instances(spark, d, "o_orderpriority"))


# whole jobs and flows


@_query("SELECT l_suppkey AS key, max(l_linenumber) top, cast(count(*) AS bigint) n FROM lineitem GROUP BY 1")
def mapreduce_job(spark: SparkSession, d: str) -> DataFrame:
    """Map, sort, merge, reduce in a given number of reducers, committed output, read back."""
    return mapreduce.job(
        _t(spark, d, "lineitem").select("l_suppkey", "l_linenumber"),
        work_dir(spark),
        lambda r: [(r["l_suppkey"], [r["l_linenumber"], 1])],
        lambda k, vs: [(k, max(v[0] for v in vs), sum(v[1] for v in vs))],
        "key bigint, value array<bigint>",
        "key bigint, top int, n bigint",
        kind="json",
        combiner=lambda k, vs: [max(v[0] for v in vs), sum(v[1] for v in vs)],
        reducers=5,
    )


def _reads(spark: SparkSession, d: str, table: str, column: str):
    return source(lambda: _t(spark, d, table).select(F.col(column).cast("bigint").alias("k")), table)


def _marked(mark: int):
    return node(lambda f: f.select(F.lit(mark).alias("mark"), "k"), f"mark {mark}")


@_query("""SELECT 0 mark, cast(n_nationkey AS bigint) k FROM nation UNION ALL SELECT 1, cast(r_regionkey AS bigint) FROM region
 UNION ALL SELECT 2, cast(n_nationkey AS bigint) FROM nation""")
def connector_zip(spark: SparkSession, d: str) -> DataFrame:
    """Outputs to inputs one by one, the shorter side reused."""
    flow = (_reads(spark, d, "nation", "n_nationkey") | _reads(spark, d, "region", "r_regionkey")).zip(_marked(0) | _marked(1) | _marked(2))
    return rows.fan_in(*flow.compile())


@_query("SELECT cast(s_nationkey AS bigint) k, count(*) * 3 n FROM supplier GROUP BY 1")
def connector_replicate(spark: SparkSession, d: str) -> DataFrame:
    """Three copies of a source, all into one counter."""
    flow = (_reads(spark, d, "supplier", "s_nationkey") ^ 3) >> node(lambda f: f.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "count")
    return flow.compile()[0]


def _diamond():
    """read >> (left | right) >> join >> write"""
    read, left, right, join, write = (node(lambda f: f, n) for n in ("read", "left", "right", "join", "write"))
    return read >> (left | right) >> join >> write


@_query("""SELECT * FROM (VALUES (0,'read',5,4,0),(1,'left',2,2,1),(2,'right',2,2,1),(3,'join',1,1,3),(4,'write',0,0,4))
 v(place, "name", edges_below, descendants, ancestors)""")
def graph_orders(spark: SparkSession, d: str) -> DataFrame:
    """Topological order, edges below, nodes below and above of a flow's nodes."""
    flow = _diamond()
    found = [(i, n.name, flow.cumulated_out_degree(n), len(flow.descendants(n)), len(flow.ancestors(n))) for i, n in enumerate(flow.topological())]
    return spark.createDataFrame(found, "place int, name string, edges_below int, descendants int, ancestors int")


@_query("""SELECT * FROM (VALUES (0,'digraph flow {'),(1,'  n0 [label="read"];'),(2,'  n1 [label="left"];'),(3,'  n2 [label="right"];'),
 (4,'  n3 [label="join"];'),(5,'  n4 [label="write", shape="box"];'),(6,'  n0 -> n1;'),(7,'  n0 -> n2;'),(8,'  n1 -> n3;'),(9,'  n2 -> n3;'),
 (10,'  n3 -> n4 [color="red"];'),(11,'}')) v(place, line)""")
def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    """A flow as DOT text, with styles of its own for a node and an edge."""
    text = _diamond().to_dot(lambda n: {"shape": "box"} if n.name == "write" else {}, lambda a, b: {"color": "red"} if b.name == "write" else {})
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "place int, line string")


@_query("""SELECT * FROM (VALUES ('read <- -', true),('left <- read', true),('right <- read', true),('join <- left, right', true),('write <- join', true)) v(line, own)""")
def plan_copy(spark: SparkSession, d: str) -> DataFrame:
    """A copy has nodes of its own and the same shape; find visits them in order."""
    flow = _diamond()
    copied = flow.copy()
    own = {n.name: n not in flow.nodes for n in copied.find(lambda n: True)}
    return spark.createDataFrame([(line, own[line.split(" <- ")[0]]) for line in copied.describe().split("\n")], "line string, own boolean")
