"""SQL of the operators that SQL can express, for DuckDB over the same tables."""

_WORDS = r"regexp_extract_all(COALESCE({0}, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = r"""
WITH t AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, UNNEST(range(0, len(x) // 2 - 49)) AS i FROM t WHERE len(x) >= 100),
w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) AS h FROM p),
m AS (SELECT h, MIN(doc_id) AS least FROM w GROUP BY h),
d AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.h = m.h WHERE w.doc_id > m.least),
g AS (SELECT doc_id, i, MAX(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
s AS (SELECT doc_id, i, SUM(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, k, MIN(i) AS a, MAX(i) + 50 AS b FROM s GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, LAG(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM r),
q AS (SELECT e.doc_id, COUNT(*) AS n_spans, SUM(b - a) AS n_removed, MAX(b) AS last, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head FROM e JOIN t ON e.doc_id = t.doc_id GROUP BY e.doc_id)
SELECT t.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN q.doc_id IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM t LEFT JOIN q ON t.doc_id = q.doc_id"""

WORDS = (
    "WITH l AS (SELECT doc_id, " + _WORDS.format("text") + r""" AS ws FROM documents),
u AS (SELECT doc_id, UNNEST(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM l),
s AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS w FROM u),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY md5(w) ORDER BY doc_id, i) AS r FROM s WHERE i + 19 <= n) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, UNNEST(range(i, i + 20)) AS i FROM d),
k AS (SELECT u.doc_id, COUNT(*) AS n_kept, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.i = g.i WHERE g.i IS NULL GROUP BY u.doc_id)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - COALESCE(n_kept, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM l LEFT JOIN k ON l.doc_id = k.doc_id"""
)

JACCARD = (
    "WITH RECURSIVE l AS (SELECT doc_id, " + _WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + r""" AS ws FROM documents),
u AS (SELECT doc_id, UNNEST(ws) AS word, generate_subscripts(ws, 1) AS i FROM l WHERE len(ws) >= 3),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, word || ' ' || LEAD(word, 1) OVER o || ' ' || LEAD(word, 2) OVER o AS s FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE s IS NOT NULL
UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM l WHERE len(ws) IN (1, 2)),
n AS (SELECT doc_id, COUNT(*) AS size FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 90 * (x.size + y.size - shared)),
v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS x FROM documents UNION SELECT r.doc_id, v.b FROM r JOIN v ON r.x = v.a),
m AS (SELECT doc_id, MIN(x) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT a, COUNT(*) AS links FROM v GROUP BY a)
SELECT m.doc_id, CAST(COALESCE(size, 0) AS BIGINT) AS n_shingles, component_id, CAST(COALESCE(links, 0) AS BIGINT) AS n_links FROM m LEFT JOIN n ON m.doc_id = n.doc_id LEFT JOIN k ON m.doc_id = k.a"""
)
