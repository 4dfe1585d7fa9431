import os

from pyspark.sql import functions as F

from tidewright.sources import connectors
from tidewright.streaming import stateful


def test_keyed_scan_and_stream(spark):
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(__file__)), os.path.dirname(__file__), spark.sparkContext.environment.get("PYTHONPATH", "")]))
    os.environ["PYTHONPATH"] = spark.sparkContext.environment["PYTHONPATH"]
    got = {r.key: r.value for r in connectors.keyed_scan(spark, "keyed_client:Client", "user:*", 3).collect()}
    assert got == {f"user:{i}": str(i * i) for i in range(10)}


def test_stream_state(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:05:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in"))
        counts = stateful.windowed(stream, "t", "1 minute", None, "1 hour", [F.count("*").alias("n")], ["k"])
        counts.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(r.key.k for r in connectors.stream_state(spark, str(tmp_path / "cp")).collect()) == [1, 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_document_options():
    o = connectors.document_options("mongodb://h", "d", "c", True, "[]")
    assert o["collection"] == "c" and o["aggregation.pipeline"] == "[]" and o["change.stream.publish.full.document.only"] == "true"
