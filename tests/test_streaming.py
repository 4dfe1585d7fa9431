"""Streaming forms against their batch results, over a file source read to its end."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.operators import correlate
from tidewright.sources import readers, sinks
from tidewright.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def files(spark, path, batches):
    """One file for each batch; names in order, so that one trigger reads one."""
    for n, batch in enumerate(batches):
        spark.createDataFrame([(u, T0 + dt.timedelta(minutes=m), i, k) for u, m, i, k in batch], "user_id int, ts timestamp, id bigint, kind string").coalesce(1).write.parquet(f"{path}/b{n}")
    schema = spark.read.parquet(f"{path}/b0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path), spark.read.option("recursiveFileLookup", "true").parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


BATCHES = [[(1, 0, 1, "a"), (2, 5, 2, "a"), (1, 20, 3, "b")], [(2, 50, 4, "b"), (1, 70, 5, "a")], [(1, 75, 6, "b"), (3, 300, 7, "a")], [(9, 900, 8, "z")]]


def test_windows(spark, tmp_path):
    stream, batch = files(spark, str(tmp_path / "in"), BATCHES)
    agg = [F.count("*").alias("n")]
    got = drain(stateful.windowed(stream, "ts", "1 minute", "5 minutes", "1 hour", agg, ["user_id"]), "w")
    want = batch.groupBy(F.window("ts", "1 hour").alias("w"), "user_id").count()
    assert {(r.window_start, r.user_id, r.n) for r in got.collect()} == {(r.w.start, r.user_id, r["count"]) for r in want.collect() if r.user_id != 9}


def test_unique(spark, tmp_path):
    stream, _ = files(spark, str(tmp_path / "in"), [[(1, 0, 1, "a"), (1, 1, 2, "a")], [(1, 2, 3, "a"), (2, 2, 4, "a")]])
    got = drain(stateful.unique(stream, ["user_id"], "ts", "1 hour"), "u")
    assert sorted(r.user_id for r in got.collect()) == [1, 2]


def test_await_equals_batch(spark, tmp_path):
    stream, batch = files(spark, str(tmp_path / "in"), BATCHES)
    side = F.when(F.col("kind") == "a", 0).otherwise(1)
    got = drain(stateful.await_stream(stream.where("kind <> 'z' OR user_id = 9"), "user_id", "id", "ts", side, "30 minutes", "1 minute"), "a")
    first, second = batch.where("kind = 'a'"), batch.where("kind <> 'a'")
    want = correlate.await_match(first, second, ["user_id"], "ts", "id", "30 minutes")
    assert {(r.key, r.first_id, r.second_id, r.outcome) for r in got.collect()} == {(str(r.user_id), r.first_id, r.second_id, r.outcome) for r in want.collect()}


def test_await_of_many_keys_takes_few_calls(spark, tmp_path):
    """Keys that share a bucket wait each for itself, over several batches; the operator is called by buckets, not by keys."""
    r = random.Random(5)
    times = sorted(r.sample(range(3000), 900))
    rows = [(r.choice([None, *range(40)]), m, i, r.choice("ab")) for i, m in enumerate(times)]
    stream, batch = files(spark, str(tmp_path / "in"), [rows[:300], rows[300:310], rows[310:620], rows[620:], [(9, 90000, 9999, "b")]])
    side = F.when(F.col("kind") == "a", 0).otherwise(1)
    calls = stateful.await_stream(stream, "user_id", "id", "ts", side, "30 minutes", "1 minute", buckets=3)
    got = drain(calls, "many")
    want = correlate.await_match(batch.where("kind = 'a'"), batch.where("kind <> 'a'"), ["user_id"], "ts", "id", "30 minutes")
    text = lambda u: None if u is None else str(u)
    assert Counter((x.key, x.first_id, x.second_id, x.outcome) for x in got.collect()) == Counter((text(x.user_id), x.first_id, x.second_id, x.outcome) for x in want.collect())
    assert len({x.outcome for x in got.collect()}) == 4


def test_hold(spark, tmp_path):
    stream, _ = files(spark, str(tmp_path / "in"), [[(1, 0, 1, "x"), (1, 1, 2, "x"), (2, 0, 3, "x")], [(1, 2, 4, "x"), (1, 3, 5, "x")], [(8, 600, 6, "x")], [(8, 1200, 7, "x")]])
    got = drain(stateful.hold_stream(stream, "user_id", "id", "ts", 3, "30 minutes", "1 minute"), "h")
    found = {(r.key, r.ids, r.outcome) for r in got.collect()}
    assert {("1", "1,2,4", "complete"), ("2", "3", "timeout"), ("1", "5", "timeout"), ("8", "6", "timeout")} <= found


def test_interval_join(spark, tmp_path):
    stream, batch = files(spark, str(tmp_path / "in"), BATCHES)
    a = stream.where("kind = 'a'").select("user_id", F.col("ts").alias("at"), F.col("id").alias("a"))
    b = stream.where("kind = 'b'").select("user_id", F.col("ts").alias("bt"), F.col("id").alias("b"))
    got = drain(stateful.interval_join(a, b, ["user_id"], "at", "bt", "10 minutes", "30 minutes"), "j")
    assert {(r.a, r.b) for r in got.collect()} == {(1, 3), (5, 6)}


def test_late_rows_go_aside(spark, tmp_path):
    stream, _ = files(spark, str(tmp_path / "in"), [[(1, 100, 1, "x")], [(1, 95, 2, "x"), (1, 10, 3, "x")]])
    splitter = stateful.LateSplitter("ts", "10 minutes", str(tmp_path / "ok"), str(tmp_path / "late"))
    sinks.each_batch(stream, str(tmp_path / "cp"), splitter).awaitTermination(120)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [3]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == [1, 2]


def test_upsert_and_completion(spark, tmp_path):
    stream, _ = files(spark, str(tmp_path / "in"), [[(1, 0, 1, "a"), (2, 1, 2, "a")], [(1, 5, 3, "b")]])
    done, store = [], str(tmp_path / "store")
    handler = sinks.with_completion(lambda df, n: sinks.upsert(df, store, "user_id", "ts", n), lambda c, n: done.extend(r.correlation_id for r in c.collect()), lambda e, n: done.append(e), "id")
    sinks.each_batch(stream, str(tmp_path / "cp"), handler).awaitTermination(120)
    last = spark.createDataFrame([], stream.schema)
    assert {(r.user_id, r.id) for r in sinks.version(last, store, 1).collect()} == {(1, 3), (2, 2)}
    assert {(r.user_id, r.id) for r in sinks.version(last, store, 0).collect()} == {(1, 1), (2, 2)}
    assert sorted(done) == [1, 2, 3]
    # only the bucket of the second batch's key was written again, and a repeated batch gives the same
    assert len(list((tmp_path / "store" / "version=1").glob("upsert_bucket=*"))) == 1
    sinks.upsert(last.unionByName(sinks.version(last, store, 1).where("user_id = 1")), store, "user_id", "ts", 1)
    assert {(r.user_id, r.id) for r in sinks.version(last, store, 1).collect()} == {(1, 3), (2, 2)}


def test_completion_files_replace_a_repeated_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    handler = sinks.with_completion(lambda df, n: None, sinks.completion_files(str(tmp_path)), lambda e, n: None, "id")
    handler(rows, 0)
    handler(rows, 0)
    handler(rows, 1)
    assert sorted((r.correlation_id, r.batch) for r in spark.read.parquet(str(tmp_path)).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_a_new_late_splitter_goes_on_where_the_old_one_was(spark, tmp_path):
    one = lambda: stateful.LateSplitter("ts", "10 minutes", str(tmp_path / "ok"), str(tmp_path / "late"))
    rows = lambda *x: spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m)) for i, m in x], "id int, ts timestamp")
    one()(rows((1, 100)), 0)
    one()(rows((2, 95), (3, 10)), 1)
    one()(rows((4, 91), (5, 89)), 2)
    one()(rows((4, 91), (5, 89)), 2)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "late")).collect()) == [3, 5]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == [1, 2, 4]


def test_sources(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,"x, y"\n2,\n')
    assert [tuple(r) for r in readers.csv(spark, str(path), "a int, b string").collect()] == [(1, "x, y"), (2, None)]
    b = readers.Bindings({"orders": {"format": "csv", "path": "${ROOT}/x.csv", "header": "${HEADER:true}"}}, {"ROOT": str(tmp_path)})
    assert b.read(spark, "orders").columns == ["a", "b"]
    with pytest.raises(KeyError):
        readers.Bindings({"t": {"path": "${NOPE}"}}, {}).resolve("t")
    bad = readers.decode_json(spark.createDataFrame([('{"k": 1}',), ("{",), (None,)], "v string"), "v", "k int", "r", "bad")
    assert [(r.r.k if r.r else None, r.bad) for r in bad.collect()][0] == (1, False)
    options = readers.kafka_options("h:9092", "t", "g", "latest", "read_committed", 5, 10)
    assert options["startingOffsets"] == "latest" and options["kafka.group.id"] == "g" and options["startingTimestamp"] == "5"
