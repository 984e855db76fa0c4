"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT rid, unnest(generate_series(1, len(w) - 2)) AS p,
         unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)]) AS g
  FROM w WHERE len(w) >= 3),
rep AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM win),
cov AS (SELECT rid, count(DISTINCT p + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS x(o) WHERE n > 1 GROUP BY rid),
ln AS (SELECT rid, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
base AS (
  SELECT d.rid, d.doc_id, d.source, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
r AS (
  SELECT *, n_words < 50 AS f_short, n_repeat_words * 100 > n_words * 50 AS f_repeats,
         n_symbols * 100 > n_words * 10 AS f_symbols, n_dup_lines * 100 > n_lines * 30 AS f_dup_lines FROM base),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (f_symbols) AS k_symbols, count(*) FILTER (f_dup_lines) AS k_dup_lines,
         count(*) FILTER (f_short OR f_repeats OR f_symbols OR f_dup_lines) AS k_any FROM r GROUP BY source),
u AS (UNPIVOT h ON k_symbols, k_dup_lines, k_any INTO NAME rule VALUE f),
m AS (
  SELECT rule, CAST(sum(n) AS DOUBLE) AS sn, count(*) AS hosts, sum(CAST(n AS DOUBLE) * n) AS sn2,
         sum(f) / CAST(sum(n) AS DOUBLE) AS m, sum(CAST(f AS DOUBLE) * f / n) / CAST(sum(n) AS DOUBLE) AS q FROM u GROUP BY rule),
s AS (
  SELECT rule, m, (q - m * m - m * (1 - m) * (hosts - 1) / sn) / nullif(1 - sn2 / (sn * sn), 0) AS t FROM m),
z AS (SELECT rule, m, CASE WHEN t > 0 THEN least(greatest(m * (1 - m) / t - 1, 1.0), 10000.0) ELSE 10000.0 END AS s FROM s),
rate AS (SELECT source, rule, n, s, m, (f + s * m) / (n + s) AS rate FROM u JOIN z USING (rule)),
post AS (SELECT *, 2.0 * sqrt(rate * (1 - rate) / (n + s + 1)) AS spread FROM rate),
v AS (
  SELECT source, bool_or(rule = 'k_any' AND rate - spread >= 0.5 AND rate - spread > m) AS host_dropped,
         bool_or(rule = 'k_symbols' AND rate + spread > 0.25 * m) AS x_symbols,
         bool_or(rule = 'k_dup_lines' AND rate + spread > 0.25 * m) AS x_dup FROM post GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short OR f_repeats AS base_failed,
       NOT (f_short OR f_repeats) AND NOT host_dropped AND NOT (f_symbols AND x_symbols) AND NOT (f_dup_lines AND x_dup) AS kept,
       host_dropped
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source
"""

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n,
         unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ') FOR i IN generate_series(1, len(w) - least(len(w), 13) + 1)]) AS g
  FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, unnest(generate_series(1, len(w) - n + 1)) AS p,
         unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN generate_series(1, len(w) - n + 1)]) AS g
  FROM d, lens WHERE len(w) >= n),
hit AS (SELECT rid, p, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (
  SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT rid, unnest(generate_series(p, p + n - 1)) AS x FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS c, row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, c, k, CAST([1, 2, 3][k % 3 + 1] AS HUGEINT) AS w, 3 * c AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap * 6 // w, k) AS i FROM w),
f AS (
  SELECT *, sum(c) OVER () - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ww FROM o),
g AS (SELECT *, cap * ww <= w * lw AS capped FROM f),
x AS (
  SELECT *, sum(c) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS fw,
         sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS fg FROM g),
t AS (
  SELECT source, c, CASE WHEN capped THEN cap ELSE CAST(w * fw AS HUGEINT) END AS num, CASE WHEN capped THEN 1 ELSE CAST(fg AS HUGEINT) END AS den,
         CAST(('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 8)) AS BIGINT) AS u FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id NULLS FIRST) AS rk FROM d),
j AS (
  SELECT doc_id, size, c, num, den, CAST(rk AS HUGEINT) AS rk, den * c AS unit, (den * c * u) // 4294967296 AS off
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CASE WHEN c > 0 THEN CAST((rk * num + off) // unit - ((rk - 1) * num + off) // unit AS BIGINT) ELSE 0 END AS copies FROM j)
SELECT doc_id, size, CAST(c AS BIGINT) AS source_size, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) AS target, size * copies AS taken, copies FROM y
"""

OP4 = r"""
WITH t AS (SELECT row_number() OVER () AS t, license, text FROM (VALUES {templates}) AS v(license, text)),
tt AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM t)) / (1.0 + count(DISTINCT t))) + 1 AS idf FROM tt GROUP BY term),
tl AS (SELECT t, sqrt(sum(tf * idf * tf * idf)) AS len FROM tt JOIN idf USING (term) GROUP BY t),
tw AS (SELECT t, license, term, tf * idf / len AS share FROM tt JOIN idf USING (term) JOIN tl USING (t)),
f AS (
  SELECT doc_id, text, coalesce(source, 'none') || '/repo' || (doc_id // 2000) AS repo, 'pkg' || (doc_id // 100) AS pkg FROM documents),
p AS (
  SELECT doc_id, text, CASE WHEN doc_id % 2000 < 20 THEN repo || '/LICENSE' WHEN doc_id % 100 < 20 THEN repo || '/' || pkg || '/LICENSE'
    ELSE repo || '/' || pkg || '/file' || doc_id || '.txt' END AS path FROM f),
ln AS (SELECT row_number() OVER () AS id, path, line FROM (SELECT path, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM p)),
tm AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM ln) GROUP BY ALL),
w AS (SELECT id, term, tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM t)) + 1) AS w FROM tm LEFT JOIN idf USING (term)),
nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
sc AS (SELECT id, license, round(sum(w * share) / any_value(norm), 6) AS score FROM w JOIN tw USING (term) JOIN nm USING (id) GROUP BY id, t, license),
own AS (
  SELECT path, license AS own_license, score AS own_score FROM sc JOIN ln USING (id) WHERE score >= 0.75
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
held AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, own_license FROM own WHERE regexp_matches(path, '/LICENSE$')),
d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM p),
up AS (SELECT dir, unnest([array_to_string(string_split(dir, '/')[1:k], '/') FOR k IN generate_series(0, len(string_split(dir, '/')))]) AS above FROM d),
r AS (
  SELECT up.dir, above, own_license AS inherited FROM up JOIN held ON above = held.dir
  QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, p.path, own_license, own_score, coalesce(own_license, inherited) AS license,
       CASE WHEN own_license IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS license_from,
       CASE WHEN own_license IS NULL THEN above END AS origin
FROM p LEFT JOIN own USING (path) LEFT JOIN r ON regexp_replace(p.path, '/[^/]*$', '') = r.dir
"""

OP9 = r"""
WITH p AS (
  SELECT page_id AS i, url, md5(coalesce(html, '')) AS dg, length(html) AS n, 'http://' || string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] || '/' AS home FROM pages),
rec AS (
  SELECT i * 4 AS record_id, url, i * 60 AS ts, 0 AS later,
    map(['content-type', 'content-length', 'etag', 'last-modified', 'date', 'server'], ['text/html', CAST(n AS VARCHAR), '"' || dg[1:16] || '"', CAST(i * 60 AS VARCHAR), CAST(i * 60 AS VARCHAR), 'a']) AS h FROM p
  UNION ALL
  SELECT i * 4 + 1, url, i * 60 + 90, 1,
    map(['content-length', 'etag', 'last-modified', 'date', 'cache-control'], ['0', CASE WHEN i % 5 = 0 THEN NULL WHEN i % 7 = 0 THEN '"old"' ELSE 'W/"' || dg[1:16] || '"' END,
      CASE WHEN i % 10 != 0 THEN CAST(i * 60 AS VARCHAR) END, CAST(i * 60 + 90 AS VARCHAR), 'max-age=60']) FROM p
  UNION ALL
  SELECT i * 4 + 2, home, i * 60, CASE WHEN i % 4 = 0 THEN 0 ELSE 1 END,
    CASE WHEN i % 4 = 0 THEN map(['content-type', 'content-length', 'etag', 'date', 'server'], ['text/html', '512', '"h' || (i // 40) || '"', CAST(i * 60 AS VARCHAR), 'b'])
    ELSE map(['etag', 'date', 'expires'], ['"h' || (i // 40) || '"', CAST(i * 60 AS VARCHAR), CAST(i * 60 AS VARCHAR)]) END FROM p),
u AS (SELECT *, string_split(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '?') AS s FROM rec),
v AS (
  SELECT *, regexp_replace(regexp_replace(lower(string_split(s[1], '/')[1]), ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(regexp_replace(s[1], '^[^/]*', ''), '/+$', '') AS b,
    array_to_string(list_sort([x FOR x IN string_split(coalesce(s[2], ''), '&') IF x != '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')]), '&') AS q FROM u),
c AS (SELECT record_id, ts, later, h, b || CASE WHEN q != '' THEN '?' || q ELSE '' END AS url FROM v),
s AS (
  SELECT *, last_value(CASE WHEN later = 0 THEN {'id': record_id, 'h': h} END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, later, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM c),
a AS (
  SELECT *, coalesce(regexp_replace(h['etag'], '^[wW]/', '') = regexp_replace(r.h['etag'], '^[wW]/', ''), h['last-modified'] = r.h['last-modified']) AS agree FROM s WHERE later = 1),
z AS (SELECT *, CASE WHEN r IS NULL THEN 'missing' WHEN agree IS NULL THEN 'unchecked' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS status FROM a),
e AS (
  SELECT record_id, unnest(map_entries(h)) AS e, 1 AS rank, status FROM z
  UNION ALL SELECT record_id, unnest(map_entries(r.h)), 2, status FROM z WHERE status IN ('resolved', 'unchecked')),
k AS (
  SELECT record_id, e.key AS key, e.value AS value FROM e WHERE e.value IS NOT NULL
    AND NOT (rank = 1 AND status IN ('resolved', 'unchecked') AND e.key IN ('connection', 'content-encoding', 'content-length', 'content-range', 'content-type', 'keep-alive', 'te', 'trailer', 'transfer-encoding', 'upgrade'))
  QUALIFY row_number() OVER (PARTITION BY record_id, e.key ORDER BY rank) = 1),
hd AS (SELECT record_id, string_agg(key || ': ' || value, chr(10) ORDER BY key) AS headers FROM k GROUP BY record_id)
SELECT record_id, url, ts, CASE WHEN status IN ('resolved', 'unchecked') THEN r.id END AS refers_to, status, coalesce(headers, '') AS headers FROM z LEFT JOIN hd USING (record_id)
"""

OP13 = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
i AS (
  SELECT row_number() OVER () AS no, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
it AS (SELECT no, item_id, unnest(w) AS term FROM i),
tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, g GROUP BY term, docs),
x AS (
  SELECT rid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))) AS x FROM tf JOIN d USING (rid), g),
s AS (
  SELECT no, item_id, doc_id, rid, CAST(sum(w * x) AS BIGINT) AS score FROM it JOIN x USING (term) JOIN wt USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS FIRST) <= 10
"""


def _vector_codes(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """SQL of operator 12: a round is an assignment and the means of it."""
    distance = " + ".join(f"(p.x[{j}] - c.x[{j}]) * (p.x[{j}] - c.x[{j}])" for j in range(1, width + 1))
    mean = ", ".join(f"(sum(x[{j}]) - ((sum(x[{j}]) % count(*)) + count(*)) % count(*)) // count(*)" for j in range(1, width + 1))
    steps = []
    for r in range(rounds + 1):
        # distance and entry in one number: the least distance, then the least entry
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT p.rid, p.part, any_value(p.x) AS x, min(({distance}) * {entries} + c.e) AS m "
            f"FROM p JOIN c{r} c USING (part) GROUP BY p.rid, p.part)"
        )
        if r < rounds:
            steps.append(f"s{r} AS (SELECT part, CAST(m % {entries} AS BIGINT) AS e, [{mean}] AS x FROM a{r} GROUP BY part, m % {entries})")
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, CAST(coalesce(s.x, c.x) AS BIGINT[]) AS x "
                f"FROM c{r} c LEFT JOIN s{r} s ON s.part = c.part AND s.e = c.e)"
            )
    last = f"c{rounds}"
    return f"""
WITH k AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS MATERIALIZED (SELECT rid, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN v] AS q FROM k),
p AS MATERIALIZED (SELECT rid, part, q[part * {width} + 1 : (part + 1) * {width}] AS x FROM q, (SELECT unnest(range({parts})) AS part)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM q QUALIFY e < {entries}),
c0 AS MATERIALIZED (SELECT part, e, x FROM f JOIN p USING (rid)),
{", ".join(steps)},
o AS (SELECT rid, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS h FROM {last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o JOIN q USING (rid), b
"""


def _templates() -> str:
    from dialogset.llm.licenses import TEMPLATES

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(a)}, {quote(b)})" for a, b in TEMPLATES)


STATEMENTS = {
    "op1_quality_rules": OP1,
    "op3_decontaminate": OP3,
    "op4_licenses": OP4.replace("{templates}", _templates()),
    "op8_mix": OP8,
    "op9_revisits": OP9,
    "op12_vector_codes": _vector_codes(),
    "op13_lexical_search": OP13,
}
