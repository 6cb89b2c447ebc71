"""Information-theoretic sanitisation of personal data, with DataFrame functions alone.

Base spans (e-mail and IP addresses, card and telephone numbers) are found by pattern. What stands near
them may reveal them: over the whole corpus, every term is counted by the documents it occurs in, and by
the documents in which it occurs within WINDOW code points of each protected value. With n documents,
PMI(term; value) = log2(n df(term, value) / (df(term) df(value))) is what the term tells about the
value, and IC(value) = log2(n / df(value)) is all there is to tell. A term whose PMI reaches
REMOVE x IC is removed near that value, from GENERALISE x IC on it is replaced by its shape, however few
documents hold the value. A term that occurs with the value alone has PMI = IC; a common word has almost 0.

Terms are runs of letters and digits, lower-cased, of at least TERM_CHARS characters; counts are kept by
64-bit hashes of terms and values. All is JVM-side; the counts are pre-aggregated before each shuffle.

Defined results: a null text has no spans and stays null when sanitised; rows that share a doc_id but
not the text are documents of their own, rows equal in both get the same spans and count as often as they occur; a value that all documents have tells nothing
(IC 0) and adds no span; a term that overlaps a base span is no span; ties can't occur, as every span of
a kind has its own start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table, text_or_empty, written

#: Fixed patterns. \G or a lookbehind pins an attempt to the start of a run, which changes no match and keeps matching linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
WINDOW, TERM_CHARS = 80, 3
GENERALISE, REMOVE = 0.75, 0.9
#: Documents that must hold a value and a term together: one will do, so nothing is cut.
SUPPORT = 1
_TERM = r"[\p{L}\p{N}]++"
_BLOCK = 64


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: expressions inside higher-order functions aren't shared."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(sizes: Column) -> Column:
    """For an array of sizes the sums of what stands before each; in blocks, so that long arrays take n^1.5 steps at most."""
    count = F.ceil(F.size(sizes) / F.lit(_BLOCK)).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def within(block: Column, start: Column) -> Column:
        return F.transform(block, lambda _, i: start + _sum(F.slice(block, F.lit(1), i)))

    def shifted(blocks: Column) -> Column:
        return _let(F.transform(blocks, _sum), lambda totals: F.flatten(F.transform(blocks, lambda b, i: _let(_sum(F.slice(totals, F.lit(1), i)), lambda start: within(b, start)))))

    return _let(F.transform(numbers, lambda n: F.slice(sizes, n * _BLOCK + 1, F.lit(_BLOCK))), shifted)


def _found(text: Column, pattern: str, kind: Column) -> Column:
    """array<struct<start, kind, stop, value>> of a pattern's matches: what stands between them gives their places."""

    def placed(values: Column, sizes: Column) -> Column:
        ends = F.zip_with(_before(sizes), sizes, lambda a, b: a + b)
        return F.zip_with(values, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), kind.alias("kind"), e.alias("stop"), v.alias("value")))

    def measured(values: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        return _let(F.zip_with(values, between, lambda v, b: (F.length(v) + F.length(b)).cast("bigint")), lambda sizes: placed(values, sizes))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), measured)


def _luhn(value: Column) -> Column:
    def total(digits: Column) -> Column:
        def worth(i: Column) -> Column:
            d = F.substring(digits, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i))

    return _let(F.reverse(F.regexp_replace(value, "[^0-9]", "")), total) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(digits.between(14, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def _validity(kind: str):
    return lambda span: _valid(kind, span["value"])


#: What a text must contain for a kind to be looked for at all: it spares most texts the slower search.
_HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "(?:[0-9][\\x20-]?){13}[0-9]", "phone": "\\+[0-9]"}
_SPANS = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop, value>>, sorted by start, then kind as listed in KINDS."""
    every = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        hint = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(_HINT[kind]))
        spans = F.filter(_found(text, pattern, F.lit(i)), _validity(kind))
        every.append(F.when(hint, spans).otherwise(F.array().cast(_SPANS)))
    return F.array_sort(F.concat(*every))


def _terms_near(text: Column, span: Column, base: Column) -> Column:
    """Terms within WINDOW code points of a span and outside all base spans; a term cut by the window's edge is left out."""

    def moved(terms: Column, by: Column) -> Column:
        return F.transform(terms, lambda t: F.struct((t["start"] + by).alias("start"), (t["stop"] + by).alias("stop"), t["value"].alias("value")))

    def left(start: Column) -> Column:
        side = F.substring(text, (start + 1).cast("int"), (span["start"] - start).cast("int"))
        whole = lambda side: F.filter(_found(side, _TERM, F.lit(4)), lambda t: (start == 0) | (t["start"] > 0))
        return moved(_let(side, whole), start)

    def right(side: Column) -> Column:
        whole = F.filter(_found(side, _TERM, F.lit(4)), lambda t: (F.length(side) < WINDOW) | (t["stop"] < WINDOW))
        return moved(whole, span["stop"])

    both = F.concat(_let(F.greatest(span["start"] - WINDOW, F.lit(0).cast("bigint")), left), _let(F.substring(text, (span["stop"] + 1).cast("int"), F.lit(WINDOW)), right))
    close = F.filter(base, lambda b: (b["stop"] > span["start"] - WINDOW) & (b["start"] < span["stop"] + WINDOW))
    return _let(close, lambda near: F.filter(both, lambda t: (F.length(t["value"]) >= TERM_CHARS) & ~F.exists(near, lambda b: (t["start"] < b["stop"]) & (b["start"] < t["stop"]))))


def _hash(value: Column) -> Column:
    return F.xxhash64(F.lower(value))


def located(keyed: DataFrame) -> DataFrame:
    """(__n, __row, doc_id, base, near) of each row of (__row, doc_id, text): a number of its own, its base spans, and what stands near each.

    One pass over the texts, which stay behind.
    """
    slim = keyed.select(F.monotonically_increasing_id().alias("__n"), "__row", "doc_id", text_or_empty().alias("text"), base_spans(text_or_empty()).alias("base"))
    around = F.transform("base", lambda s: F.struct(_hash(s["value"]).alias("entity"), _terms_near(F.col("text"), s, F.col("base")).alias("terms")))
    shown = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.lit(1.0).cast("double").alias("share")))
    return written(slim.select("__n", "__row", "doc_id", shown.alias("base"), around.alias("near")))


def revealing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(__row, terms) of rows where terms near base spans disclose them: array<struct<start, kind, stop, share>>."""
    near = found.select("__n", "__row", F.explode("near").alias("n")).select("__n", "__row", "n.entity", F.explode_outer("n.terms").alias("t"))
    near = near.select("__n", "__row", "entity", _hash(F.col("t.value")).alias("term"), F.col("t.start").alias("start"), F.col("t.stop").alias("stop"))
    together = near.where("start is not null").select("__n", "entity", "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    with_entity = near.select("__n", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(_TERM), F.lit(0)))).alias("w"))
    with_term = words.where(F.length("w") >= TERM_CHARS).groupBy(F.xxhash64("w").alias("term")).agg(F.count(F.lit(1)).alias("df_term"))
    total = F.lit(float(found.count()))
    told = together.join(with_entity, "entity").join(with_term, "term")
    ic, pmi = F.log2(total / F.col("df_entity")), F.log2(total * F.col("both") / (F.col("df_term") * F.col("df_entity")))
    told = told.select("entity", "term", (pmi / F.nullif(ic, F.lit(0.0))).alias("share")).where(F.col("share") >= GENERALISE)
    spans_of = near.where("start is not null").join(told, ["entity", "term"]).groupBy("__row", "start", "stop").agg(F.max("share").alias("share"))
    return spans_of.groupBy("__row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "stop", "share")).alias("terms"))


_NO_SPANS = "array<struct<start:bigint,kind:int,stop:bigint,share:double>>"


def _all_spans() -> Column:
    return F.array_sort(F.concat(F.col("base"), F.coalesce(F.col("terms"), F.array().cast(_NO_SPANS))))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with personal data and what discloses it taken out of the text, and n_chars renewed where it exists."""
    keyed = docs.select(row_key().alias("__row"), F.col("doc_id"), F.col("text"))
    found = located(keyed)
    spans = found.where(F.size("base") > 0).join(revealing(docs, found), "__row", "left").select(F.col("__row").alias("__found"), _all_spans().alias("__spans")).dropDuplicates(["__found"])
    joined = docs.withColumn("__key", row_key()).join(spans, F.col("__key") == F.col("__found"), "left")
    touched = F.col("__spans").isNotNull()
    clean = F.when(touched, _replaced(text_or_empty(), F.col("__spans"))).otherwise(F.col("text"))
    columns = [F.col(c) for c in docs.columns if c not in ("text", "n_chars")]
    joined = joined.select(*columns, clean.alias("text"), *([F.col("n_chars").alias("__n")] if "n_chars" in docs.columns else []), touched.alias("__touched"))
    if "n_chars" in docs.columns:
        renewed = F.when(F.col("__touched"), F.length("text")).otherwise(F.col("__n")).cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", renewed)
    return joined.select(*docs.columns)


def _replaced(text: Column, spans: Column) -> Column:
    """Spans sorted by start; of overlapping ones the first counts and reaches as far as the furthest."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        word = F.substring(text, (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int"))
        shape = F.regexp_replace(F.regexp_replace(word, r"\p{N}+", "0"), r"\p{L}+", "x")
        mark = F.when(x["kind"] < 4, F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), (x["kind"] + 1).cast("int")), F.lit("]"))).when(x["share"] >= REMOVE, F.lit("[term]")).otherwise(shape)
        gap = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        fresh = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(s["parts"], F.array(gap, mark))).otherwise(s["parts"]).alias("parts"))

    done = F.aggregate(spans, state, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return done


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), (s["kind"] + 1).cast("int"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """For each row its doc_id, counts and lists of base spans and of all spans."""
    found = located(docs.select(row_key().alias("__row"), F.col("doc_id"), F.col("text")))
    joined = found.drop("near", "__n").join(revealing(docs, found), "__row", "left")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)]
    return joined.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(_all_spans()).alias("spans"))


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
