"""Looking at, replaying, thinning and counting streams of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def peek(df: DataFrame, n: int, where: Column | None = None) -> DataFrame:
    """Up to `n` rows that hold."""
    return (df if where is None else df.where(F.coalesce(where, F.lit(False)))).limit(n)


def replay(df: DataFrame, where: Column | None = None, assign: dict[str, Column] | None = None, time: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows again: bounded in time, filtered, with fields set anew."""
    if time and since:
        df = df.where(F.col(time) >= F.lit(since).cast(df.schema[time].dataType))
    if time and until:
        df = df.where(F.col(time) <= F.lit(until).cast(df.schema[time].dataType))
    if where is not None:
        df = df.where(F.coalesce(where, F.lit(False)))
    df = df.withColumns(assign) if assign else df
    return df if limit is None else df.limit(limit)


def thin(df: DataFrame, rate: float, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Backpressure by sampling: the share `rate` of keys, the same ones each time."""
    return df.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000))


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """Counters that are filled as the rows pass by, without another pass."""
    told = Observation(name)
    return df.observe(told, *(c.alias(n) for n, c in counters.items())), told


def histogram(df: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Rows by bucket: `le` is the least bound not below the value (null: above all)."""
    le = F.lit(None).cast("double")
    for b in reversed(bounds):
        le = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(le)
    return df.groupBy(*keys, le.alias("le")).agg(F.count("*").alias("n"))


def rate(df: DataFrame, time: str, every: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows a second in each window."""
    w = F.window(F.col(time).cast("timestamp"), every)
    seconds = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, (F.col("n") / seconds).alias("rate"))


def encode(df: DataFrame, fmt: str = "json", into: str = "value", schema: str | None = None) -> DataFrame:
    """All columns as one: json, csv, or avro (whose module must be on the class path)."""
    record = F.struct("*")
    if fmt == "json":
        return df.select(F.to_json(record).alias(into))
    if fmt == "csv":
        return df.select(F.to_csv(record).alias(into))
    if fmt == "avro":
        from pyspark.sql.avro.functions import to_avro

        return df.select(to_avro(record, schema or "").alias(into))
    raise ValueError(f"no format {fmt!r}")
