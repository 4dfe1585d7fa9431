"""Every registered query of the engine against its SQL, in DuckDB over the same tables."""

import decimal
import math
import os

import duckdb
import pytest

from tidewright import catalog

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    sql = catalog.oracle_sql()[name]
    kinds = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    columns = sorted(df.columns)
    assert columns == sorted(kinds)
    for c in columns:
        assert KINDS.get(df.schema[c].dataType.simpleString()) == kinds[c], c
    got = duck.execute(sql)
    at = {d[0]: i for i, d in enumerate(got.description)}
    want = sorted((tuple(plain(r[at[c]]) for c in columns) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
