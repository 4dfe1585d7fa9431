"""Services, tools, markers and geohashes."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright import catalog
from tidewright.operators import rows, services, tools


def test_retries_then_fallback():
    calls, pauses = [], []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return batch

    policy = services.Policy(retries=3, base_seconds=1, jitter=0)
    run = services.guarded(flaky, policy, services.Breaker(policy), pauses.append)
    assert run(pd.Series([1])).tolist() == [1] and pauses == [1, 2]


def test_breaker():
    now = [0.0]
    policy = services.Policy(retries=0, failures_to_open=2, open_seconds=10)
    breaker = services.Breaker(policy, lambda: now[0])
    works, calls = [False], []

    def call(batch):
        calls.append(1)
        if not works[0]:
            raise OSError
        return batch

    run = services.guarded(call, policy, breaker, lambda s: None)
    assert run(pd.Series([1])) is None and breaker.state == "closed"
    assert run(pd.Series([1])) is None and breaker.state == "open"
    assert run(pd.Series([1])) is None and len(calls) == 2  # no call while open
    now[0], works[0] = 11.0, True
    assert breaker.state == "half open" and run(pd.Series([5])).tolist() == [5] and breaker.state == "closed"


def test_service_falls_back(spark):
    def broken(v: pd.Series) -> pd.Series:
        raise OSError("down")

    ask = services.service(broken, "int", services.Policy(retries=0), fallback=-1)
    assert [r.x for r in spark.range(3).select(ask(F.col("id")).alias("x")).collect()] == [-1, -1, -1]


def plain_geohash(lat, lon, letters):
    low, high, out, even = [-90.0, -180.0], [90.0, 180.0], "", True
    for _ in range(letters):
        value = 0
        for _ in range(5):
            i, v = (1, lon) if even else (0, lat)
            middle = (low[i] + high[i]) / 2
            value = value * 2 + (v >= middle)
            (low if v >= middle else high)[i] = middle
            even = not even
        out += "0123456789bcdefghjkmnpqrstuvwxyz"[value]
    return out


def test_geohash(spark):
    got = {r.s_suppkey: r.geohash for r in catalog.queries()["domain_geohash"](spark, "/root/testdata/sf0.01").collect()}
    assert got and all(g == plain_geohash(k % 180 - 90 + 0.123, k * 7 % 360 - 180 + 0.456, 7) for k, g in got.items())


def test_observed_counts_pass_by(spark):
    df, told = tools.observed(spark.range(10), "seen", rows=F.count("*"), big=F.count_if(F.col("id") > 6))
    assert df.count() == 10 and told.get == {"rows": 10, "big": 3}


def test_thinning_keeps_whole_keys(spark):
    df = spark.range(4000).withColumn("k", F.col("id") % 1000)
    kept = tools.thin(df, 0.25, ["k"])
    assert kept.count() == 4 * kept.select("k").distinct().count() and 150 < kept.select("k").distinct().count() < 350


def test_encode(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert tools.encode(df).first()[0] == '{"n":1,"s":"a"}' and tools.encode(df, "csv").first()[0] == "1,a"
    with pytest.raises(ValueError):
        tools.encode(df, "xml")


def test_peek_is_two_valued(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "a int")
    assert tools.peek(df, 5, F.col("a") > 1).count() == 1 and rows.keep(df, ~rows.two_valued(F.col("a") > 1)).count() == 2
