"""Two-stream patterns in event time: await and hold, over bounded data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def await_match(first: DataFrame, second: DataFrame, keys: Sequence[str], time: str, ident: str, timeout: str) -> DataFrame:
    """Latest pending first event of the key meets the next second event, once, within the timeout.

    One row an event that ends a wait or goes without: outcome `matched`,
    `timeout` (a first event that no second one took in time) or `unmatched`
    (a second event with nothing pending). A newer first event replaces a
    pending one, whose outcome is `replaced`. Null keys never match: such a first
    event times out, such a second one is unmatched.
    """
    a = first.select(*keys, F.col(time).alias("_t"), F.col(ident).alias("_id"), F.lit(0).alias("_side"))
    b = second.select(*keys, F.col(time).alias("_t"), F.col(ident).alias("_id"), F.lit(1).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_id")
    both = a.unionByName(b)
    seq = both.select("*", F.lag("_side").over(w).alias("_ps"), F.lag("_t").over(w).alias("_pt"), F.lag("_id").over(w).alias("_pid"), F.lead("_side").over(w).alias("_ns"), F.lead("_t").over(w).alias("_nt"))
    bound = F.expr(f"INTERVAL {timeout}")
    # the latest first event is pending exactly if it stands right before
    takes = (F.col("_side") == 1) & (F.col("_ps") == 0) & (F.col("_t") <= F.col("_pt") + bound)
    taken = (F.col("_side") == 0) & (F.col("_ns") == 1) & (F.col("_nt") <= F.col("_t") + bound)
    replaced = (F.col("_side") == 0) & (F.col("_ns") == 0) & (F.col("_nt") <= F.col("_t") + bound)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    takes, taken, replaced = (F.coalesce(x & keyed, F.lit(False)) for x in (takes, taken, replaced))
    outcome = F.when(takes, "matched").when(F.col("_side") == 1, "unmatched").when(replaced, "replaced").otherwise("timeout")
    out = seq.where(~taken).withColumn("outcome", outcome)
    return out.select(
        *keys,
        F.when(F.col("_side") == 0, F.col("_id")).when(takes, F.col("_pid")).alias("first_id"),
        F.when(F.col("_side") == 1, F.col("_id")).alias("second_id"),
        "outcome",
        F.when(F.col("outcome") == "timeout", F.col("_t") + bound).otherwise(F.when(replaced, F.col("_nt")).otherwise(F.col("_t"))).alias("at"),
    )


def on_timeout(outcomes: DataFrame, action: str, reason: str = "timed out") -> tuple[DataFrame, DataFrame]:
    """What goes on and what goes aside after a wait or a hold (rows with an `outcome`).

    emit: timeouts go on with the rest, as what they are; dead_letter: they go
    aside with a `reason`; skip: they are left out.
    """
    timed_out = F.col("outcome") == "timeout"
    if action == "emit":
        return outcomes, outcomes.where(F.lit(False)).withColumn("reason", F.lit(reason))
    if action == "dead_letter":
        return outcomes.where(~timed_out), outcomes.where(timed_out).withColumn("reason", F.lit(reason))
    if action == "skip":
        return outcomes.where(~timed_out), outcomes.where(F.lit(False)).withColumn("reason", F.lit(reason))
    raise ValueError(f"unknown action {action!r}")


def hold_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int, record: Column) -> tuple[DataFrame, DataFrame]:
    """Full batches of `count` rows of a key, and the rows of the last, incomplete one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("_n") / count))
    sized = numbered.withColumn("_size", F.count("*").over(Window.partitionBy(*keys, "batch")))
    full = sized.where(F.col("_size") == count).groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), record.alias("r")))).alias("_b"))
    return full.select(*keys, "batch", F.transform("_b", lambda x: x["r"]).alias("held")), sized.where(F.col("_size") < count).drop("_n", "_size", "batch")


def hold_window(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], timeout: str, count: int | None = None, marker: Column | None = None) -> DataFrame:
    """Buffers of a key that start at their first row and live for the timeout; each row gets its buffer (from 1) and the buffer's outcome.

    A buffer is `complete` once it has `count` rows or a row where `marker`
    holds, else `timeout`; the next one begins at the row after it. One key's
    rows are taken together, buffer by buffer. Rows without a time are left out.
    """
    at = F.col(time).cast("timestamp")
    marked = df.withColumns(
        {
            "_at": F.unix_micros(at),
            "_end": F.unix_micros(at + F.expr(f"INTERVAL {timeout}")),
            "_mark": F.coalesce(marker, F.lit(False)) if marker is not None else F.lit(False),
        }
    ).where("_at IS NOT NULL")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_at", *order], kind="stable")
        starts, ends, marks = rows["_at"].to_numpy(), rows["_end"].to_numpy(), np.flatnonzero(rows["_mark"].to_numpy())
        number, done = np.zeros(len(rows), np.int32), np.zeros(len(rows), bool)
        first = buffer = 0
        while first < len(rows):
            last, complete = int(np.searchsorted(starts, ends[first], "right")), False
            if count is not None and first + count <= last:
                last, complete = first + count, True
            mark = int(np.searchsorted(marks, first))
            if mark < len(marks) and marks[mark] < last:
                last, complete = int(marks[mark]) + 1, True
            buffer += 1
            number[first:last], done[first:last] = buffer, complete
            first = last
        return rows.drop(columns=["_at", "_end", "_mark"]).assign(buffer=number, outcome=np.where(done, "complete", "timeout"))

    schema = StructType([*df.schema.fields, StructField("buffer", IntegerType()), StructField("outcome", StringType())])
    return marked.groupBy(*keys).applyInPandas(run, schema)
