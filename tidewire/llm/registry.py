"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewire.llm import queries as q

QUERIES = {
    f.__name__: f
    for f in (
        q.op1_url_filter, q.op2_chat_format, q.op3_pii, q.op4_suffix_dedup, q.op5_quality,
        q.op6_packing, q.op7_decontamination, q.op8_line_dedup, q.op9_simhash, q.op10_embedding_dedup,
        q.op11_language_id, q.op12_periodic_runs, q.op13_ranked_search,
    )
}

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in q.URL_RULES)

#: crc32 of the decimal doc_id, byte by byte through the polynomial's table.
_CRC = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
ids AS (SELECT *, row_number() OVER () AS rid FROM documents),
crc AS (SELECT rid, doc_id, text, CASE WHEN doc_id IS NULL THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) END AS h FROM ids, tab)"""

#: DuckDB SQL. Queries without an entry (3 to 9 and 11) need iteration, XXH64, a tokenizer or a fitted model;
#: tests/llm holds them against brute force.
ORACLES = {
    "op1_url_filter": rf"""
WITH RECURSIVE
rules(verdict, rhost, rpath) AS (VALUES {_RULES}),
p AS (
  SELECT page_id, url, html, row_number() OVER () AS rid,
    CASE WHEN contains(url, '://') THEN lower(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*')) ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site
  FROM pages),
l AS (
  SELECT url, site, path, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') AS folder, unnest(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*(?:"[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical\b)')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))
    || list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1))) AS link
  FROM p),
k AS (SELECT *, regexp_extract(link, '(?s)^([^?#]*)', 1) AS stem, regexp_extract(link, '(?s)^[^?#]*(.*)$', 1) AS rest FROM (SELECT * REPLACE (regexp_replace(link, '(?i)&(?:amp|#38|#x26);', '&', 'g') AS link) FROM l) WHERE link <> ''),
d AS (SELECT *, CASE WHEN starts_with(stem, '/') THEN stem ELSE folder || stem END AS whole FROM k WHERE contains(url, '://')),
f AS (SELECT url, CASE
  WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN starts_with(link, '//') THEN 'http:' || link WHEN stem = '' THEN site || path || rest
  ELSE site || list_reduce(list_prepend('', str_split(whole || CASE WHEN regexp_matches(whole, '/\.\.?$') THEN '/' ELSE '' END, '/')[2:]),
    lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END) || rest END AS t FROM d),
u AS (SELECT DISTINCT x AS url, regexp_replace(lower(regexp_extract(x, '(?s)^.*?://([^/?#]*)', 1)), CASE WHEN regexp_matches(x, '^(?i)http://') THEN ':80$' WHEN regexp_matches(x, '^(?i)https://') THEN ':443$' ELSE '^$' END, '') AS h,
  regexp_extract(x, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS tail FROM (SELECT url AS x FROM p UNION ALL SELECT t FROM f) WHERE contains(x, '://')),
key AS (SELECT url, h || CASE WHEN starts_with(tail, '/') THEN '' ELSE '/' END || tail AS node FROM u),
e AS (SELECT a.node AS a, b.node AS b FROM f JOIN key a ON a.url = f.url JOIN key b ON b.url = f.t),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
n AS (SELECT DISTINCT b AS node, regexp_extract(b, '^[^/?]*') AS host, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS path FROM r),
nr AS (SELECT node, arg_min(verdict, (-length(rhost || rpath), verdict)) AS verdict FROM n JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY node),
c AS (SELECT r.a AS node, coalesce(bool_or(verdict = 'block'), false) AND NOT coalesce(bool_or(verdict = 'allow'), false) AS hit FROM r LEFT JOIN nr ON nr.node = r.b GROUP BY r.a),
pr AS (SELECT rid, arg_min(rhost || rpath, (-length(rhost || rpath), verdict)) AS rule, arg_min(verdict, (-length(rhost || rpath), verdict)) AS verdict FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(pr.verdict, CASE WHEN c.hit THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN pr USING (rid) LEFT JOIN key ON key.url = p.url LEFT JOIN c ON c.node = key.node""",
    "op2_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) + 8
    + CASE WHEN before IS DISTINCT FROM role THEN 6 + length(role) + length(role) - length(replace(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''), chr(10), '')) ELSE 0 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id""",
    "op12_periodic_runs": rf"""
WITH {_CRC},
d AS (SELECT rid, doc_id, h, h // 10 AS g, w, len(w) AS n FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM crc)),
p AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM d),
t AS (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS w FROM p),
pairs AS (SELECT a.rid, a.i, a.i - b.i AS q FROM t a JOIN t b ON a.rid = b.rid AND a.w = b.w AND b.i < a.i AND 4 * (a.i - b.i) <= a.n),
lags AS (SELECT rid, q, min(i) - q AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island),
longest AS (SELECT * FROM lags WHERE m >= greatest(6, 4 * q)),
runs AS (SELECT * FROM longest x WHERE NOT EXISTS (SELECT 1 FROM longest y WHERE y.rid = x.rid AND y.q < x.q AND y.s <= x.s AND y.s + y.m >= x.s + x.m)),
told AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM runs GROUP BY rid),
top AS (SELECT rid, s, m, q FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY m / q DESC, s, q) = 1),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS said FROM t WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.rid = t.rid AND t.i >= r.s + r.q AND t.i < r.s + r.m) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s::BIGINT AS start, m::BIGINT AS length, q::BIGINT AS period, (1000 * m // q)::BIGINT AS exponent_milli,
  sha256(coalesce(told.said, '')) AS runs_sha256, sha256(coalesce(kept.said, '')) AS collapsed_sha256
FROM p LEFT JOIN told USING (rid) LEFT JOIN top USING (rid) LEFT JOIN kept USING (rid)""",
    "op13_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT count(*) AS nn, sum(len(terms))::HUGEINT AS ll FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, nn),
m AS (SELECT rid, doc_id, (10 + (90 * len(terms) * nn) // ll)::BIGINT AS m FROM d, g),
s AS (SELECT item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, rid)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM s JOIN m USING (rid) WHERE score > 0 QUALIFY rank <= 10""",
}
