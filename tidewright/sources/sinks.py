"""Writing: files, keyed upserts, completion events, late and failed rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.operators.joins import merge_into


def envelope(df: DataFrame, key: Sequence[str], **extra: str) -> DataFrame:
    """key and value columns as a message sink takes them; extra literals become headers of the value."""
    for name, text in extra.items():
        df = df.withColumn(name, F.lit(text))
    return df.select(F.to_json(F.struct(*key)).alias("key"), F.to_json(F.struct("*")).alias("value"))


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def fan_out_partitions(df: DataFrame, n: int) -> DataFrame:
    """Round robin over n partitions."""
    return df.repartition(n)


#: Buckets of a keyed store; a batch rewrites those that it has keys of.
BUCKETS = 64
_BUCKET = "upsert_bucket"


def upsert(df: DataFrame, path: str, key: str, order: str, number: int, buckets: int = BUCKETS) -> None:
    """The last row of each key wins over what is stored.

    Keys are hashed into buckets, and batch `number` writes new versions of the
    buckets that it touches, each from the bucket's version before; a list of
    the buckets' versions says what the store holds after the batch. So a batch
    that is repeated gives the same.
    """
    columns = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_s")).select(key, *(F.col(f"_s.{c}").alias(c) for c in columns))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = {r[0] for r in last.select(bucket).distinct().collect()}  # `buckets` rows at most
    before = _versions(df, path, number - 1) if number else {}
    stored = _stored(df, path, {b: v for b, v in before.items() if b in touched})
    new = merge_into(stored, last, key, columns) if stored is not None else last
    new.withColumn(_BUCKET, bucket).repartition(F.col(_BUCKET)).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/version={number}")
    known = [*{**before, **dict.fromkeys(touched, number)}.items()]
    df.sparkSession.createDataFrame(known, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/batch={number}")


def _versions(df: DataFrame, path: str, number: int) -> dict[int, int]:
    """Version of each bucket after a batch (one row a bucket)."""
    return {r["bucket"]: r["version"] for r in df.sparkSession.read.schema("bucket int, version int").parquet(f"{path}/versions/batch={number}").collect()}


def _stored(df: DataFrame, path: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    return df.sparkSession.read.schema(df.schema).parquet(*(f"{path}/version={v}/{_BUCKET}={b}" for b, v in sorted(versions.items())))


def version(df: DataFrame, path: str, number: int) -> DataFrame:
    """What was stored after a batch."""
    found = _stored(df, path, _versions(df, path, number))
    return found if found is not None else df.limit(0)


def each_batch(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = True, every: str | None = None) -> StreamingQuery:
    """A streaming sink: `handle` gets each micro-batch and its number, and must give the same when it is repeated."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def with_completion(target: Callable[[DataFrame, int], None], completed: Callable[[DataFrame, int], None], failed: Callable[[str, int], None], correlation: str, include: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """After a batch is written its completion rows are; if writing fails, the failure is told and raised again.

    `completed` gets the batch's number: a batch that is repeated must not tell twice (see `completion_files`).
    """

    def handle(df: DataFrame, number: int) -> None:
        try:
            target(df, number)
        except Exception as error:
            failed(str(error), number)
            raise
        completed(df.select(F.col(correlation).alias("correlation_id"), *include, F.lit(number).alias("batch")), number)

    return handle


def completion_files(path: str) -> Callable[[DataFrame, int], None]:
    """Completion rows as files, one folder a batch, which a repeated batch replaces."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/completed={number}")
