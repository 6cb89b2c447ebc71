"""SQL that checks those training-data queries that SQL can express."""

from __future__ import annotations

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(f"substr('{_ALPHABET}', cast((v >> {shift}) % 32 AS int) + 1, 1)" for shift in (15, 10, 5, 0))

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 h AS (SELECT page_id, html, sha1(html) AS hex FROM p),
 d AS (SELECT page_id, html, array_to_string(list_transform(list_transform(range(0, 8), lambda i: cast('0x' || substr(hex, cast(5*i+1 AS int), 5) AS bigint)),
  lambda v: {_DIGITS}), '') AS digest FROM h),
 r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, cast(octet_length(encode(html)) AS bigint) AS payload_bytes, digest AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < first_id THEN first_id END AS refers_to FROM r"""

#: Every string of 100 bytes by document and place; those that are not the first of their kind cover what goes. Bytes are hex digits,
#: cut in blocks first because a place in a long text is slow to reach.
REPEATS = """WITH d AS (SELECT doc_id, upper(hex(encode(coalesce(text, '')))) AS x FROM documents),
 n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
 b AS (SELECT doc_id, n, unnest(range(0, greatest(n - 99, 0), 500)) AS a, x FROM n),
 c AS (SELECT doc_id, a, least(500, n - 99 - a) AS k, substr(x, cast(2*a+1 AS int), 1200) AS block FROM b),
 s AS (SELECT doc_id, a, block, unnest(range(0, k)) AS i FROM c),
 g AS (SELECT doc_id, a + i AS p, row_number() OVER (PARTITION BY md5_number(substr(block, cast(2*i+1 AS int), 200)) ORDER BY doc_id, a + i) AS r FROM s),
 o AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM g WHERE r > 1),
 e AS (SELECT doc_id, p, sum(CASE WHEN p <= q + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
 t AS (SELECT doc_id, run, min(p) AS p0, max(p) + 100 AS p1 FROM e GROUP BY 1, 2),
 u AS (SELECT doc_id, p0, p1, coalesce(lag(p1) OVER (PARTITION BY doc_id ORDER BY p0), 0) AS kept0 FROM t),
 k AS (SELECT u.doc_id, sum(p1 - p0) AS gone, count(*) AS spans, max(p1) AS last, string_agg(substr(x, cast(2*kept0+1 AS int), cast(2*(p0-kept0) AS int)), '' ORDER BY p0) AS kept
  FROM u JOIN n USING (doc_id) GROUP BY 1)
SELECT doc_id, cast(n AS bigint) AS n_bytes, cast(coalesce(gone, 0) AS bigint) AS n_removed, cast(coalesce(spans, 0) AS bigint) AS n_spans,
 sha256(unhex(coalesce(kept, '') || substr(x, cast(2*coalesce(last, 0)+1 AS int)))) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)"""


def _simhash() -> str:
    """XXH64 in 128-bit arithmetic, step by step, then bits, links of two bits at most and what they reach."""
    m, p1, p2, p3, p4, p5, seed = 2**64, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261, 42

    def u(value: int) -> str:
        return f"cast('{value % m}' AS uhugeint)"

    def turned(x: str, bits: int) -> str:
        return f"((({x}) * {u(2**bits)}) % cast('{m}' AS uhugeint) + ({x}) // {u(2 ** (64 - bits))})"

    def mod(x: str) -> str:
        return f"(({x}) % cast('{m}' AS uhugeint))"

    def lane(at: str, size: int) -> str:
        """Little-endian number of so many bytes; rx has the bytes from the last to the first."""
        return f"cast(cast('0x' || substr(rx, cast(2*(n - ({at}) - {size}) + 1 AS int), {2 * size}) AS ubigint) AS uhugeint)"

    def stirred(acc: str, value: str) -> str:
        return f"list_transform([{mod(f'{acc} + {value} * {u(p2)}')}], lambda t: {mod(f'{turned("t", 31)} * {u(p1)}')})[1]"

    start = [seed + p1 + p2, seed + p2, seed, seed - p1]
    wide = ", ".join(f"list_reduce(list_transform(range(0, n // 32), lambda k: {lane(f'32*k + {8 * j}', 8)}), lambda a, l: {stirred('a', 'l')}, {u(start[j])}) AS v{j}" for j in range(4))
    first = " + ".join(turned(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18)))
    merged = mod(first)
    steps = [f"a AS (SELECT s, rx, n, {wide} FROM x)", f"m0 AS (SELECT *, {merged} AS h FROM a)"]
    for j in range(4):
        steps.append(f"m{j + 1} AS (SELECT * REPLACE ({mod(f'xor(h, {stirred(u(0), f"v{j}")}) * {u(p1)} + {u(p4)}')} AS h) FROM m{j})")
    steps.append(f"c0 AS (SELECT s, rx, n, {mod(f'CASE WHEN n >= 32 THEN h ELSE {u(seed + p5)} END + cast(n AS uhugeint)')} AS h FROM m4)")
    eight = f"list_transform([xor(h0, {stirred(u(0), 'l')})], lambda t: {mod(f'{turned("t", 27)} * {u(p1)} + {u(p4)}')})[1]"
    steps.append(f"c1 AS (SELECT s, rx, n, list_reduce(list_transform(range(0, (n % 32) // 8), lambda k: {lane('32*(n//32) + 8*k', 8)}), lambda h0, l: {eight}, h) AS h FROM c0)")
    steps.append(f"c2 AS (SELECT s, rx, n, CASE WHEN n % 8 >= 4 THEN xor(h, {mod(f'{lane("n - n%8", 4)} * {u(p1)}')}) ELSE h END AS h FROM c1)")
    steps.append(f"c3 AS (SELECT s, rx, n, CASE WHEN n % 8 >= 4 THEN {mod(f'{turned("h", 23)} * {u(p2)} + {u(p3)}')} ELSE h END AS h FROM c2)")
    one = f"list_transform([xor(h0, {mod(f'l * {u(p5)}')})], lambda t: {mod(f'{turned("t", 11)} * {u(p1)}')})[1]"
    steps.append(f"c4 AS (SELECT s, list_reduce(list_transform(range(0, n % 4), lambda k: {lane('n - n%4 + k', 1)}), lambda h0, l: {one}, h) AS h FROM c3)")
    steps.append(f"c5 AS (SELECT s, {mod(f'xor(h, h // {u(2**33)}) * {u(p2)}')} AS h FROM c4)")
    steps.append(f"c6 AS (SELECT s, {mod(f'xor(h, h // {u(2**29)}) * {u(p3)}')} AS h FROM c5)")
    steps.append(f"c7 AS (SELECT s, cast(xor(h, h // {u(2**32)}) AS ubigint) AS h FROM c6)")
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {u(2**b)} ELSE {u(0)} END" for b in range(64))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS w FROM documents),
 e AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
 x AS (SELECT s, array_to_string(list_reverse(regexp_extract_all(hex(encode(s)), '..')), '') AS rx, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM e)),
 {", ".join(steps)},
 f AS (SELECT doc_id, cast({bits} AS ubigint) AS fp FROM e JOIN c7 USING (s) GROUP BY doc_id),
 d AS (SELECT doc_id, coalesce(fp, 0::ubigint) AS fp FROM documents LEFT JOIN f USING (doc_id)),
 g AS (SELECT fp, min(doc_id) AS least FROM d GROUP BY fp),
 l AS (SELECT a.fp AS u, b.fp AS v FROM g a JOIN g b ON bit_count(cast(xor(a.fp, b.fp) AS hugeint)) <= 2),
 r AS (SELECT fp AS u, fp AS v FROM g UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
 o AS (SELECT r.u AS fp, min(g.least) AS component_id FROM r JOIN g ON r.v = g.fp GROUP BY 1)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM d JOIN o USING (fp)"""


SIMHASH = _simhash()


def _disclosure() -> str:
    """Base spans from matches and what stands between them, then terms in the windows, counts of documents, and shares."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN cast(substr(reverse({digits}), cast(i AS int), 1) AS int)
      ELSE (2 * cast(substr(reverse({digits}), cast(i AS int), 1) AS int)) // 10 + (2 * cast(substr(reverse({digits}), cast(i AS int), 1) AS int)) % 10 END)) % 10 = 0"""
    kinds = [
        ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
        ("[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR cast('0' || right(p, 3) AS int) > 255)) = 0"),
        ("[0-9](?:[\\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        ("\\+[0-9][\\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
    ]

    def placed(source: str, keep: str, text: str, pattern: str) -> str:
        """Matches v of a pattern with their start a."""
        return f"""SELECT {keep}, unnest(vs) AS v, unnest(list_transform(range(1, len(vs) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(vs[1:i-1], lambda y: length(y))), 0))) AS a
   FROM (SELECT {keep}, regexp_extract_all({text}, '{pattern}') AS vs, string_split_regex({text}, '{pattern}') AS gs FROM {source})"""

    base = " UNION ALL ".join(f"SELECT r, {k} AS kind, cast(a AS bigint) AS a, cast(a + length(v) AS bigint) AS b, v FROM ({placed('t', 'r', 'x', pattern)}) WHERE {valid}" for k, (pattern, valid) in enumerate(kinds))
    term = "[\\p{L}\\p{N}]+"
    name = "['email', 'ip', 'card', 'phone', 'term'][kind + 1]"
    listed = f"string_agg({name} || ':' || a || ':' || b, ',' ORDER BY a, kind, b)"
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
 s AS MATERIALIZED ({base}),
 w AS (SELECT s.r, s.a AS sa, s.b AS sb, lower(v) AS entity, greatest(s.a - 80, 0) AS la, substr(x, cast(greatest(s.a - 80, 0) + 1 AS int), cast(s.a - greatest(s.a - 80, 0) AS int)) AS lx, substr(x, cast(s.b + 1 AS int), 80) AS rx FROM s JOIN t USING (r)),
 n0 AS (SELECT r, entity, la + a AS a, la + a + length(v) AS b, v FROM ({placed('w', 'r, entity, la', 'lx', term)}) WHERE la = 0 OR a > 0
  UNION ALL SELECT r, entity, sb + a, sb + a + length(v), v FROM ({placed('w', 'r, entity, sb, rx', 'rx', term)}) WHERE length(rx) < 80 OR a + length(v) < 80),
 n AS MATERIALIZED (SELECT DISTINCT r, entity, cast(a AS bigint) AS a, cast(b AS bigint) AS b, lower(v) AS term FROM n0 WHERE length(v) >= 3 AND NOT EXISTS (SELECT 1 FROM s WHERE s.r = n0.r AND n0.a < s.b AND s.a < n0.b)),
 pairs AS (SELECT entity, term, count(DISTINCT r) AS c FROM n GROUP BY 1, 2),
 de AS (SELECT lower(v) AS entity, count(DISTINCT r) AS de FROM s GROUP BY 1),
 dt AS (SELECT term, count(*) AS dt FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(x), '{term}'))) AS term FROM t) GROUP BY 1),
 told AS (SELECT entity, term FROM pairs JOIN de USING (entity) JOIN dt USING (term), (SELECT cast(count(*) AS double) AS total FROM t)
  WHERE log2(total * c / (dt * de)) / nullif(log2(total / de), 0) >= 0.75),
 f AS (SELECT r, kind, a, b FROM s UNION ALL SELECT DISTINCT r, 4, a, b FROM n JOIN told USING (entity, term)),
 g AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS c{k}" for k in range(4))}, {listed.replace("string_agg(", "string_agg(CASE WHEN kind < 4 THEN ", 1).replace(", ',' ORDER", " END, ',' ORDER", 1)} AS own, {listed} AS every FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"cast(coalesce(c{k}, 0) AS bigint) AS n_{kind}" for k, kind in enumerate(("email", "ip", "card", "phone")))}, sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans FROM t LEFT JOIN g USING (r)"""


DISCLOSURE = _disclosure()

#: Starts are pairs of places with the same five words. Those that follow each other in both texts make a run; of each pair of texts
#: the longest run (then the earliest) is marked in every round, and what touches it goes.
TILING = """WITH RECURSIVE d AS (SELECT row_number() OVER () AS d, * FROM (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents)),
 b AS (SELECT row_number() OVER () AS b, * FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) >= 5),
 i5 AS (SELECT b, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT b, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
 d5 AS (SELECT d, j, array_to_string(w[j:j+4], ' ') AS s FROM (SELECT d, w, unnest(range(1, len(w) - 3)) AS j FROM d)),
 r AS (SELECT 0 AS round, d, b, i, j FROM d5 JOIN i5 USING (s) UNION ALL
  SELECT round + 1, d, b, i, j FROM (SELECT *, first_value(i0) OVER best AS bi, first_value(j0) OVER best AS bj, first_value(n) OVER best AS bn FROM (
   SELECT *, count(*) OVER run AS n, min(i) OVER run AS i0, min(j) OVER run AS j0 FROM (SELECT *, i - row_number() OVER (PARTITION BY d, b, j - i ORDER BY i) AS g FROM r)
   WINDOW run AS (PARTITION BY d, b, j - i, g)) WINDOW best AS (PARTITION BY d, b ORDER BY n DESC, i0, j0))
  WHERE (i < bi - 4 OR i > bi + bn + 3) AND (j < bj - 4 OR j > bj + bn + 3)),
 t AS (SELECT d, b, round, max(n) + 4 AS n FROM (SELECT d, b, round, count(*) AS n FROM (
   SELECT *, i - row_number() OVER (PARTITION BY round, d, b, j - i ORDER BY i) AS g FROM r) GROUP BY d, b, round, j - i, g) GROUP BY 1, 2, 3),
 c AS (SELECT doc_id, item_id, cast(len(b.w) AS bigint) AS item_words, cast(sum(n) AS bigint) AS covered, cast(max(n) AS bigint) AS longest FROM t JOIN d USING (d) JOIN b USING (b) GROUP BY t.d, t.b, 1, 2, 3)
SELECT doc_id, item_id, max(item_words) AS item_words, max(covered) AS covered, max(longest) AS longest, max(covered / item_words) AS coverage FROM c WHERE covered / item_words >= 0.5 GROUP BY 1, 2"""
