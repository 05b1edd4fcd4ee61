"""SQL of the queries that it can express over whole tables; each is written from the contract, not from the operator."""

from __future__ import annotations

_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_joined = lambda words: f"list_aggregate({words}, 'string_agg', ' ')"

#: Lines as lower-case words; a line goes if an earlier one is equal, or is one word away and both have five words.
LINE_DEDUP = rf"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, i, regexp_extract_all(lower(ls[i]), '{_SPACED}') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t WHERE doc_id IS NOT NULL)),
  w AS (SELECT doc_id, i, w, {_joined("w")} AS k FROM l WHERE len(w) > 0),
  c AS (SELECT k, any_value(w) AS w, min((doc_id, i)) AS first FROM w GROUP BY k),
  v AS (SELECT k, first, len(w) AS n, unnest(range(1, len(w) + 1)) AS p, w FROM c WHERE len(w) >= 5),
  d AS (SELECT k, first, n, p, coalesce({_joined("list_concat(w[:p - 1], w[p + 1:])")}, '') AS x FROM v),
  r AS (SELECT x, p, min(first) AS other FROM d GROUP BY x, p HAVING count(*) > 1),
  near AS (SELECT k FROM d JOIN r USING (x, p) WHERE other < first
    UNION SELECT d.k FROM d JOIN c ON c.k = d.x AND len(c.w) >= 5 WHERE c.first < d.first UNION SELECT c.k FROM d JOIN c ON c.k = d.x AND len(c.w) >= 5 WHERE d.first < c.first),
  gone AS (SELECT doc_id, list(i) AS g FROM (SELECT w.doc_id, w.i FROM w JOIN c USING (k) WHERE (w.doc_id, w.i) <> c.first OR w.k IN (SELECT k FROM near)) GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(list_aggregate(list_filter(ls, lambda x, i: g IS NULL OR NOT list_contains(g, i)), 'string_agg', chr(10)), '')) END AS kept_sha256
FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id"""

#: Occurrences of all windows of ten words of the benchmark, marked word by word.
DECONTAMINATE = rf"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format(c="text")}, '{_WORD}') AS w FROM documents),
  bw AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER.format(c="text")}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
  bp AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM bw WHERE len(w) > 0),
  ph AS (SELECT DISTINCT item_id, n, {_joined("w[i:i + n - 1]")} AS p FROM bp),
  dg AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, (SELECT DISTINCT n FROM ph) WHERE len(w) >= n),
  hit AS (SELECT r, i, ph.n AS n, item_id FROM (SELECT r, n, i, {_joined("w[i:i + n - 1]")} AS p FROM dg) d JOIN ph ON d.p = ph.p AND d.n = ph.n),
  hw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
  it AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON hw.r = dw.r LEFT JOIN it ON it.r = dw.r"""

#: All pairs with a common shingle, counted; components by recursion.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format(c="text")}, '{_SPACED}') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [{_joined("w")}] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM dw),
  u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
  pr AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY
      a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
  c AS (SELECT DISTINCT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.v),
  m AS (SELECT v, min(r) AS component_id FROM c GROUP BY v)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON v = doc_id"""

#: Digests of the pages themselves, without any archive between.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + (i // 4) * 5,
      5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM g"""

#: Groups against their language, all sums in whole numbers.
SOURCE_AUDIT = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
  v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
  n AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
  p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (n.n + 2 * v.v) AS p, 1 + (1000000000 * (k.c::HUGEINT + 2)) // (v.n + 2 * v.v) AS q
    FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
  s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f) WHERE part = 'pair' OR rank <= 10
"""

#: Rules as rows, the longest that fits by a plain join; sites by the labels of the host.
URL_FILTER = r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
  u AS (SELECT page_id, row_number() OVER () AS i, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  f AS (SELECT i, max_by(h || p, len(h || p)) AS rule, max_by(v, len(h || p)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (i)
"""

ORACLES = {"op2_line_dedup": LINE_DEDUP, "op6_decontaminate": DECONTAMINATE, "op9_near_duplicates": NEAR_DUPLICATES, "op10_warc": WARC, "op12_source_audit": SOURCE_AUDIT, "op13_url_filter": URL_FILTER}
