"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 19, 0))) AS s FROM d),
h AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 20], ' ')) AS k FROM g),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1 AS late FROM h),
c AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS i FROM f WHERE late),
u AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
k AS (SELECT u.doc_id, string_agg(u.w[u.i + 1], ' ' ORDER BY u.i) FILTER (WHERE c.i IS NULL) AS kept, count(c.i) AS n_removed
      FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

ORACLES["op5_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, h FROM (
  SELECT doc_id, md5(array_to_string(w[i + 1:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sig AS (SELECT doc_id, md5(string_agg(h, '' ORDER BY h)) AS g FROM s GROUP BY 1),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS r FROM sig),
x AS (SELECT s.doc_id, s.h FROM s JOIN rep ON s.doc_id = rep.doc_id AND rep.r = rep.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
      UNION SELECT r, doc_id FROM rep WHERE r <> doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, seen) AS (SELECT a, a FROM e UNION SELECT e.b, r.seen FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id)::BIGINT AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.node
"""

ORACLES["op8_secret_scan"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS o, coalesce(source, '') || '/' || coalesce(lang, '') AS p, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT r, doc_id, o, p, 0 AS rank, 'assign' AS kind, 6 AS least, string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g,
    regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS f,
    regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS v FROM d
  UNION ALL SELECT r, doc_id, o, p, 1, 'access', 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, doc_id, o, p, 2, 'hex', 24, string_split_regex(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT r, doc_id, o, p, 3, 'owned', 20, string_split_regex(t, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}') FROM d),
i AS (SELECT *, unnest(range(1, len(f) + 1)) AS n FROM m),
s AS (SELECT r, doc_id, o, p, rank, kind, v[n] AS value, least, len(f[n]) AS size,
        list_sum(list_transform(g[1:n], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:n - 1], lambda x: len(x))), 0) AS start FROM i),
b AS (SELECT *, start + size AS stop FROM s WHERE len(value) >= least),
a AS (SELECT * FROM b WHERE kind <> 'owned' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
        AND NOT EXISTS (SELECT 1 FROM b c WHERE c.r = b.r AND c.kind <> 'owned' AND b.start < c.stop AND c.start < b.stop))),
n AS (SELECT value, count(DISTINCT o) < 3 AND count(DISTINCT p) < 6 AS live FROM a GROUP BY 1),
u AS (SELECT a.*, live FROM a JOIN n USING (value) WHERE kind <> 'owned' OR live),
z AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (WHERE kind <> 'owned') AS base,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied
      FROM u GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN z ON d.r = z.r
"""
