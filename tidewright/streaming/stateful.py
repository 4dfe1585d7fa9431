"""Streaming forms: windows with watermarks, dedupe, late rows, await and hold with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


def windowed(df: DataFrame, time: str, delay: str, lateness: str | None, size: str, aggregates: Sequence[Column], keys: Sequence[str] = (), every: str | None = None) -> DataFrame:
    """Aggregates of windows; rows count until the watermark (delay and allowed lateness together) has passed their window."""
    bound = f"{_seconds(delay) + (_seconds(lateness) if lateness else 0)} seconds"
    window = F.window(time, size, every) if every else F.window(time, size)
    counted = df.withWatermark(time, bound).groupBy(window.alias("w"), *keys).agg(*aggregates)
    rest = [c for c in counted.columns if c != "w" and c not in keys]
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *rest)


def _seconds(duration: str) -> int:
    """"5 minutes" and the like."""
    count, unit = duration.split()
    return int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")]


def unique(df: DataFrame, keys: Sequence[str], time: str, window: str) -> DataFrame:
    """The first row of each key within the window."""
    return df.withWatermark(time, window).dropDuplicatesWithinWatermark(list(keys))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, before: str, after: str, how: str = "inner") -> DataFrame:
    """Stream to stream: state is kept only as long as the bounds and both watermarks ask for."""
    l, r = left.withWatermark(left_time, after), right.withWatermark(right_time, before)
    r = r.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in r.columns if c not in keys))
    near = (F.col(right_time) >= F.col(left_time) - F.expr(f"INTERVAL {before}")) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {after}"))
    condition = near
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_r_{k}"))
    return l.join(r, condition, how).drop(*(f"_r_{k}" for k in keys))


_OUT = StructType([StructField("key", StringType()), StructField("first_id", LongType()), StructField("second_id", LongType()), StructField("outcome", StringType())])
#: What waits in one bucket: keys, the events that stand for a null key (each by itself), ids and times.
_PENDING = StructType([StructField("keys", ArrayType(StringType())), StructField("lone", ArrayType(LongType())), StructField("ids", ArrayType(LongType())), StructField("times", ArrayType(LongType()))])
#: Keys are kept together by their hash: so many calls at most for a batch, however many keys it has.
AWAIT_BUCKETS = 4096


def _outcomes(rows: pd.DataFrame, limit: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Outcomes among rows (key, lone, id, t, side; _new: not one that waited before) of many keys, and the first events that still wait.

    A first event waits exactly until the next row of its key, so every row is judged by the one before it.
    """
    rows = rows.assign(_who=rows.groupby(["key", "lone"], dropna=False, sort=False).ngroup()).sort_values(["_who", "_new", "t", "side", "id"])
    who, t, side, ids, new = (rows[c].to_numpy() for c in ("_who", "t", "side", "id", "_new"))
    same = who[1:] == who[:-1]
    waits = np.append(False, same & (side[:-1] == 0))  # the row before is a first event of this key
    before_t, before_id = np.append(0, t[:-1]), np.append(0, ids[:-1])
    late = waits & (t > before_t + limit)
    matched = waits & ~late & (side == 1)
    key = rows["key"].to_numpy()

    def part(some: np.ndarray, outcome: str, first: np.ndarray | None, second: np.ndarray | None) -> pd.DataFrame:
        column = lambda x: pd.array(x[some], "Int64") if x is not None else pd.array([None] * int(some.sum()), "Int64")
        return pd.DataFrame({"key": key[some], "first_id": column(first), "second_id": column(second), "outcome": outcome})

    out = pd.concat([
        part(late, "timeout", before_id, None),
        part(waits & ~late & (side == 0), "replaced", before_id, None),
        part(matched, "matched", before_id, ids),
        part(new & (side == 1) & ~matched, "unmatched", None, ids),
    ])
    return out, rows[np.append(~same, True) & (side == 0)]


def await_stream(events: DataFrame, key: str, ident: str, time: str, side: Column, timeout: str, delay: str, buckets: int = AWAIT_BUCKETS) -> DataFrame:
    """First events (side 0) wait for second ones (side 1) of their key; outcomes as in operators.correlate.await_match.

    Event-time timers: a wait ends when the watermark has passed its end. Events
    with a null key wait each by itself, so they never match. Keys are dealt into
    `buckets` by their hash; a bucket's waits are one state, and its rows of a
    batch are handled together, so a batch costs by its rows, not by its keys.
    The number must stay the same for a checkpoint; a state is rewritten when its
    bucket has rows, so very many waiting keys with small batches ask for more.
    """
    limit = _seconds(timeout) * 1000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        kept = pd.DataFrame(dict(zip(("key", "lone", "id", "t"), state.get if state.exists else ([], [], [], []))))
        kept = kept.astype({"key": object, "lone": "Int64", "id": "int64", "t": "int64"}).assign(side=0, _new=False)
        if state.hasTimedOut:
            out = []
        else:
            batch = pd.concat(list(frames))[["key", "lone", "id", "t", "side"]].astype({"key": object, "lone": "Int64", "id": "int64", "t": "int64"}).assign(_new=True)
            found, kept = _outcomes(pd.concat([kept, batch]) if len(kept) else batch, limit)
            out = [found]
        over = (kept["t"] + limit < now) & (now > 0)
        if over.any():
            out.append(pd.DataFrame({"key": kept["key"][over], "first_id": kept["id"][over].astype("Int64"), "second_id": pd.array([None] * int(over.sum()), "Int64"), "outcome": "timeout"}))
            kept = kept[~over]
        if len(kept):
            state.update(([None if pd.isna(x) else x for x in kept["key"]], [None if pd.isna(x) else int(x) for x in kept["lone"]], kept["id"].tolist(), kept["t"].tolist()))
            state.setTimeoutTimestamp(max(int(kept["t"].min()) + limit, now + 1))
        elif state.exists:
            state.remove()
        yield pd.concat(out) if out else pd.DataFrame(columns=_OUT.names)

    lone = F.when(F.col(key).isNull(), F.col(ident).cast("bigint"))
    marked = events.withWatermark(time, delay).select(F.col(key).cast("string").alias("key"), F.col(ident).cast("bigint").alias("id"), F.unix_millis(time).alias("t"), side.cast("int").alias("side"), lone.alias("lone"), F.col(time).alias("_time"))
    dealt = marked.withColumn("bucket", F.pmod(F.xxhash64("key", "lone"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInPandasWithState(step, _OUT, _PENDING, "append", GroupStateTimeout.EventTimeTimeout)


_HELD = StructType([StructField("key", StringType()), StructField("ids", StringType()), StructField("outcome", StringType())])
_BUFFER = StructType([StructField("ids", StringType()), StructField("since", LongType())])


def hold_stream(events: DataFrame, key: str, ident: str, time: str, count: int, timeout: str, delay: str) -> DataFrame:
    """Buffers of a key, emitted at `count` rows or when the timeout after their first row has passed."""
    limit = _seconds(timeout) * 1000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, since = (state.get[0].split(","), state.get[1]) if state.exists else ([], None)
        rows = []
        if state.hasTimedOut:
            rows.append((k[0], ",".join(held), "timeout"))
            state.remove()
            yield pd.DataFrame(rows, columns=_HELD.names)
            return
        for t, i in pd.concat(list(frames)).sort_values(["t", "id"])[["t", "id"]].itertuples(index=False):
            if held and t > since + limit:
                rows.append((k[0], ",".join(held), "timeout"))
                held = []
            if not held:
                since = int(t)
            held.append(str(int(i)))
            if len(held) >= count:
                rows.append((k[0], ",".join(held), "complete"))
                held = []
        if held:
            state.update((",".join(held), since))
            state.setTimeoutTimestamp(max(since + limit, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=_HELD.names)

    marked = events.withWatermark(time, delay).select(F.col(key).cast("string").alias("key"), F.col(ident).cast("bigint").alias("id"), F.unix_millis(time).alias("t"), F.col(time).alias("_time"))
    return marked.groupBy("key").applyInPandasWithState(step, _HELD, _BUFFER, "append", GroupStateTimeout.EventTimeTimeout)


class LateSplitter:
    """foreachBatch handler that writes rows in time to one place and late ones to another.

    The watermark of a batch is the greatest time of all batches before it, less
    the delay. It is written beside the late rows after every batch, so that a
    query that starts again, or repeats a batch, judges as it did before.
    """

    def __init__(self, time: str, delay: str, in_time: str, late: str):
        self.time, self.seconds, self.in_time, self.late = time, _seconds(delay), in_time, late
        self.number, self.seen = -1, None

    def _before(self, df: DataFrame, number: int):
        """Greatest time of the batches before, from memory or from what was written."""
        if number == 0 or self.number == number - 1:
            return self.seen if number else None
        return df.sparkSession.read.schema("seen timestamp").parquet(f"{self.late}/_seen/batch={number - 1}").first()["seen"]

    def __call__(self, df: DataFrame, number: int) -> None:
        seen = self._before(df, number)
        bound = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {self.seconds} SECONDS") if seen is not None else F.lit(None).cast("timestamp")
        judged = df.withColumn("_late", F.coalesce(F.col(self.time) < bound, F.lit(False)))
        judged.where(~F.col("_late")).drop("_late").write.mode("overwrite").parquet(f"{self.in_time}/batch={number}")
        judged.where("_late").drop("_late").write.mode("overwrite").parquet(f"{self.late}/batch={number}")
        newest = df.agg(F.max(self.time)).first()[0]
        self.number, self.seen = number, newest if seen is None else max(seen, newest or seen)
        df.sparkSession.createDataFrame([(self.seen,)], "seen timestamp").coalesce(1).write.mode("overwrite").parquet(f"{self.late}/_seen/batch={number}")
