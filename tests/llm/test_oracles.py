"""Operators that SQL can express, against DuckDB over the given tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from tidewright.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    want = sorted(got.fetchall())
    df = catalog.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_every_query_runs(spark):
    for name, query in catalog.queries().items():
        assert query(spark, FOLDER).count() >= 200, name


LARGER = "/root/testdata/sf0.01"
WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"
#: What SQL can say of queries that it can't say whole, over all of a table.
PARTS = {
    "op6_secret_scan": r"""SELECT doc_id,
len(list_filter(regexp_extract_all(COALESCE(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS n_assign,
len(list_filter(regexp_extract_all(COALESCE(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
len(list_filter(regexp_extract_all(COALESCE(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM documents""",
    "op7_quality_rules": f"""WITH l AS (SELECT doc_id, {WORDS} AS ws, COALESCE(text, '') AS text FROM documents),
u AS (SELECT doc_id, UNNEST(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM l),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM u),
t AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, w) AS c FROM g WHERE i + 4 <= n),
r AS (SELECT doc_id, COUNT(DISTINCT k) AS n_repeat FROM (SELECT doc_id, UNNEST(range(i, i + 5)) AS k FROM t WHERE c > 1) GROUP BY doc_id),
c AS (SELECT l.doc_id, len(ws) AS n_words, COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, COALESCE(n_repeat, 0) AS n_repeat_words FROM l LEFT JOIN r ON l.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c""",
    "op8_fingerprint": """WITH t AS (SELECT doc_id, COALESCE(text, '') AS text, COALESCE(LEAD(text) OVER (ORDER BY doc_id), CASE WHEN LEAD(doc_id) OVER (ORDER BY doc_id) IS NULL THEN FIRST_VALUE(text) OVER (ORDER BY doc_id) END, '') AS next_ FROM documents)
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(next_, length(text) // 2)) AS edited_sha256 FROM t""",
    "op10_sharding": "SELECT doc_id, strlen(COALESCE(text, '')) + 1 AS size, 'bytes' AS law FROM documents",
    "op2_quality_classifier": "SELECT doc_id FROM documents",
    "op5_bpe": "SELECT doc_id FROM documents",
}


@pytest.fixture(scope="module")
def larger():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{LARGER}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(PARTS))
def test_columns_that_sql_can_say(spark, larger, name):
    got = larger.execute(PARTS[name])
    columns = [d[0] for d in got.description]
    want = sorted(got.fetchall())
    rows = catalog.queries()[name](spark, LARGER).collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == want and len(rows) == 1000
    texts = dict(larger.execute("SELECT doc_id, COALESCE(text, '') FROM documents").fetchall())
    if name == "op10_sharding":
        assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
        sums = Counter()
        for r in rows:
            sums[r.shard] += r["size"]
        assert max(sums.values()) - min(sums.values()) <= 2 * max(r["size"] for r in rows)
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    if name == "op2_quality_classifier":
        labels = dict(larger.execute(f"SELECT doc_id, quality FROM '{LARGER}/labels.parquet'").fetchall())
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
        held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
        assert all(p for p, y in held if y) and sum(p for p, y in held if not y) <= 0.2 * sum(not y for _, y in held)
    if name == "op5_bpe":
        import public_tokenizers
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        for r in rows:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    if name == "op7_quality_rules":
        labels = dict(larger.execute(f"SELECT doc_id, quality FROM '{LARGER}/labels.parquet'").fetchall())
        judged = [(r.kept, labels[r.doc_id]) for r in rows if not r.base_failed and r.doc_id in labels]
        assert all(kept for kept, y in judged if y) and sum(kept for kept, y in judged if not y) <= 5
