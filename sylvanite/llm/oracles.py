"""SQL of the corpus queries that it can express, by plain joins over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"

#: windows of items against windows of documents; longest matches are runs of windows along a diagonal
OP1_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
  i AS (SELECT item_id, row_number() OVER () AS t, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
  iw AS (SELECT item_id, t, least(len(w), 10) AS k, o, array_to_string(w[o + 1 : o + least(len(w), 10)], ' ') AS g FROM i, UNNEST(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 9, 1) END)) AS u(o)),
  dw AS (SELECT r, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM d, (SELECT DISTINCT k FROM iw) AS s, UNNEST(range(greatest(len(w) - k + 1, 0))) AS u(p)),
  m AS (SELECT r, p, k, item_id, t, o FROM dw JOIN iw USING (k, g)),
  hit AS (SELECT r, count(DISTINCT p + x) AS n_hit FROM (SELECT DISTINCT r, p, k FROM m) AS q, UNNEST(range(k)) AS u(x) GROUP BY r),
  run AS (SELECT r, item_id, k, p, t, p - o AS diagonal, p - row_number() OVER (PARTITION BY r, t, k, p - o ORDER BY p) AS island FROM m),
  best AS (SELECT r, item_id, max(n) AS longest FROM (SELECT r, item_id, count(*) + k - 1 AS n FROM run GROUP BY r, item_id, t, k, diagonal, island) AS q GROUP BY r, item_id),
  found AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items, string_agg(CAST(longest AS VARCHAR), ',' ORDER BY item_id) AS longest FROM best GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, '') AS longest
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)"""

#: all pairs that share a shingle, compared exactly; components by reachability
OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {_TOKENS} AS w FROM documents),
  sh AS (SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS g FROM d, UNNEST(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS t(i)),
  n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
  both_ AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM sh AS a JOIN sh AS b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
  link AS (SELECT x, y FROM both_ JOIN n AS p ON p.r = x JOIN n AS q ON q.r = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
  arc AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
  reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, arc.y FROM reach JOIN arc ON arc.x = reach.y),
  least AS (SELECT reach.x AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN least USING (r) LEFT JOIN n USING (r)"""

#: every 400-byte string by its hash (texts in blocks of 400 starts, as cutting a long text is slow); removed bytes are the union of those that occur twice
OP10_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
  block AS (SELECT r, k, substr(h, 2 * k + 1, 1598) AS p FROM d, UNNEST(range(0, greatest(len(h) // 2 - 399, 0), 400)) AS t(k)),
  w AS (SELECT r, k + j AS i, md5_number(substr(p, 2 * j + 1, 800)) AS g FROM block, UNNEST(range(least(400, len(p) // 2 - 399))) AS t(j)),
  hit AS (SELECT r, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
  mark AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM hit),
  part AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM mark),
  span AS (SELECT r, s, min(i) AS a, max(i) + 400 AS z FROM part GROUP BY 1, 2),
  gap AS (SELECT r, s, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
  kept AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS h, sum(z - a) AS n, count(*) AS spans FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
