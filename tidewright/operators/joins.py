"""Joins: interval, window co-group, enrichment, lookup, as-of, buffers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which `sized` lets a frame be broadcast.
BROADCAST_ROWS = 200_000


def sized(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most `rows` rows. Counting stops one row beyond.

    The joins below give no hint: Spark broadcasts a side whose size it knows to
    be small, and adaptive execution one that turns out to be. This is for
    frames that are small for certain but costly to shuffle the other side for.
    """
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, before: str, after: str, how: str = "inner", bucket_seconds: int | None = None) -> DataFrame:
    """Pairs of equal keys with right time in [left time - before, left time + after], both ends in.

    Column names of both sides must differ, but for the keys. With
    `bucket_seconds` (>= the longer bound, inner joins) time buckets become a
    second equi key: each right row is put in its own and both neighbouring
    buckets, so a key with very many rows is spread over time.
    """
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    near = (F.col(right_time) >= F.col(left_time) - F.expr(f"INTERVAL {before}")) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {after}"))
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    if bucket_seconds is not None:
        if how != "inner":
            raise ValueError("time buckets are for inner joins")
        slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_seconds * 1_000_000))
        left = left.withColumn("_slot", slot(left_time))
        r = r.withColumn("_r_slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: slot(right_time) + d)))
        same.append(F.col("_slot") == F.col("_r_slot"))
    joined = left.join(r, [*same, near], how)
    if how in ("right", "full", "outer"):
        for k in keys:
            joined = joined.withColumn(k, F.coalesce(F.col(k), F.col(f"_r_{k}")))
    return joined.drop("_slot", "_r_slot", *(f"_r_{k}" for k in keys))


def cogroup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, size: str, how: str = "left") -> DataFrame:
    """Pairs of equal keys in the same tumbling window; unmatched rows by `how`."""
    l = left.withColumn("_w", F.window(F.col(left_time).cast("timestamp"), size)["start"])
    r = right.withColumn("_w", F.window(F.col(right_time).cast("timestamp"), size)["start"])
    return l.join(r, [*keys, "_w"], how).withColumnRenamed("_w", "window_start")


def enrich(df: DataFrame, dim: DataFrame, on: Sequence[str], fields: Sequence[str], how: str = "left") -> DataFrame:
    """Fields of a dimension by key."""
    return df.join(dim.select(*on, *fields), list(on), how)


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], fields: Sequence[str], found: str = "found") -> DataFrame:
    """As enrich, and whether the key was there."""
    return df.join(dim.select(*on, *fields, F.lit(True).alias(found)), list(on), "left").withColumn(found, F.coalesce(F.col(found), F.lit(False)))


def lookup_or(df: DataFrame, dim: DataFrame, on: Sequence[str], field: str, default, into: str | None = None) -> DataFrame:
    """One field by key, or the default if it is missing or null."""
    side = dim.select(*on, F.col(field).alias("_v"))
    return df.join(side, list(on), "left").withColumn(into or field, F.coalesce(F.col("_v"), F.lit(default))).drop("_v")


def lookup_as_of(df: DataFrame, history: DataFrame, keys: Sequence[str], time: str, effective: str, fields: Sequence[str]) -> DataFrame:
    """For each row the fields of the key's latest history row at or before its time; null if there is none.

    One shuffle: both sides are put in one stream ordered by time, and the last
    history record is carried forward. If several history rows have the same
    time, the one of greatest fields counts. Null keys never match: a row with
    one gets null fields.
    """
    history = history.dropna(subset=list(keys))
    # history comes first among equal times; one history row for each key and time
    h = history.groupBy(*keys, effective).agg(F.max(F.struct(*fields)).alias("_f")).select(*keys, F.col(effective).alias("_t"), F.lit(0).alias("_s"), F.struct(F.col(effective).alias("_e"), *(F.col(f"_f.{f}").alias(f) for f in fields)).alias("_h"))
    d = df.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_s"), F.struct(*df.columns).alias("_d"))
    both = h.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_h", F.last("_h", ignorenulls=True).over(w)).where("_s = 1")
    return carried.select("_d.*", F.col("_h._e").alias(effective), *(F.col(f"_h.{f}").alias(f) for f in fields))


def lookup_valid(df: DataFrame, history: DataFrame, keys: Sequence[str], time: str, start: str, end: str, fields: Sequence[str]) -> DataFrame:
    """The history row whose [start, end) holds the time; an open end is null."""
    h = history.select(*(F.col(k).alias(f"_h_{k}") for k in keys), start, end, *fields)
    valid = (F.col(time) >= F.col(start)) & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    return df.join(h, [*(F.col(k) == F.col(f"_h_{k}") for k in keys), valid], "left").drop(*(f"_h_{k}" for k in keys))


def match_from_buffer(stream: DataFrame, buffer: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a stream with the rows stored in a buffer under the same keys."""
    return stream.join(buffer, list(on))


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_anti")


# -- keyed comparison of two streams ------------------------------------------------
def diff(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], ignore: Sequence[str] = (), left_order: Column | None = None, right_order: Column | None = None) -> DataFrame:
    """One row a key: left_only, right_only, match or different, and the fields that changed. The last row of a key counts."""

    def last(df: DataFrame, order: Column | None, side: str) -> DataFrame:
        if order is not None:
            df = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("_n = 1")
        return df.select(F.col(key), F.struct(*fields).alias(side))

    both = last(left, left_order, "_l").join(last(right, right_order, "_r"), key, "full")
    compared = [f for f in fields if f not in ignore]
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_l.{f}").eqNullSafe(F.col(f"_r.{f}")), F.lit(f)) for f in compared)))
    status = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").when(F.size(changed) == 0, "match").otherwise("different")
    return both.select(key, status.alias("status"), F.when(status == "different", changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def merge_into(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str], delete: Column | None = None) -> DataFrame:
    """Upsert: the source's columns win where the key is in both, new keys are added, keys with `delete` (over source columns) go."""
    s = source.select(F.col(key), F.struct(*columns).alias("_s"), (F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)).alias("_gone"))
    both = target.join(s, key, "full").where(~F.coalesce(F.col("_gone"), F.lit(False)))
    return both.select(key, *(F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in columns))
