"""DuckDB SQL that says what some operators return, over the whole tables and with none of their methods."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 800)) AS m FROM (SELECT doc_id, h, unnest(range(n - 399)) AS p FROM d WHERE n >= 400)),
r AS (SELECT doc_id, p FROM s WHERE m IN (SELECT m FROM s GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM i),
k AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS words FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS words FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM t) WHERE len(w) >= size)),
m AS (SELECT doc_id, item_id, k, x.size FROM x JOIN t ON x.words = t.words AND x.size = t.size),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

NEAR_DUPS = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 4], ' ')) AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both_ FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) USING (doc_id)
"""
