"""Streaming forms run to the end of a file source, against the SQL of their batch forms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.queries import joins  # noqa: F401  its SQL is used here
from tidewright.queries.registry import SQL, Tables, query
from tidewright.session import shared_folder
from tidewright.streaming import stateful


def _events(t: Tables) -> DataFrame:
    """The event table as a stream of files."""
    path = f"{t.folder}/events.parque[t]"  # a pattern, since the source takes folders or patterns
    stream = t.spark.readStream.schema(t.events.schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Every row that the stream has given once its source is read to the end, written by the executors batch by batch (complete: each batch replaces the one before)."""
    spark = df.sparkSession
    folder = shared_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows").select(df.columns)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(t: Tables):
    counts = stateful.windowed(_events(t), "ts", "1 hour", "1 hour", "1 hour", [F.count("*").alias("n"), F.sum("value").alias("total")], ["event_type"])
    return _drained(counts, "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_dedupe(t: Tables):
    return _drained(stateful.unique(_events(t), ["user_id", "event_type"], "ts", "1000 days").select("user_id", "event_type"))


@query(SQL["await_match"])
def stream_await(t: Tables):
    both = _events(t).where(F.col("event_type").isin("view", "purchase"))
    side = F.when(F.col("event_type") == "view", 0).otherwise(1)
    got = _drained(stateful.await_stream(both, "user_id", "event_id", "ts", side, "24 hours", "1 hour"))
    return got.where("outcome = 'matched'").select(F.col("key").cast("bigint").alias("user_id"), "first_id", "second_id")


@query("""WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT c.user_id, c.event_id AS c_id, p.event_id AS p_id FROM c JOIN p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts - INTERVAL 1 HOUR AND c.ts + INTERVAL 6 HOUR""")
def stream_interval_join(t: Tables):
    side = lambda kind, time, ident: _events(t).where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(time), F.col("event_id").alias(ident))
    return _drained(stateful.interval_join(side("click", "c_ts", "c_id"), side("purchase", "p_ts", "p_id"), ["user_id"], "c_ts", "p_ts", "1 hour", "6 hours").select("user_id", "c_id", "p_id"))
