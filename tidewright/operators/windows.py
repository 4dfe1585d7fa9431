"""Time windows, count windows, late rows, aggregates and analytic functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Timestamps with a watermark (a zone-less column is taken as UTC)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling(df: DataFrame, time: str, size: str, aggregates: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates for each window [start, end) and key, windows aligned to the epoch."""
    return _flat(df.groupBy(F.window(F.col(time).cast("timestamp"), size).alias("_w"), *keys).agg(*aggregates), keys)


def sliding(df: DataFrame, time: str, size: str, every: str, aggregates: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """As tumbling, with windows of `size` that start every `every`."""
    return _flat(df.groupBy(F.window(F.col(time).cast("timestamp"), size, every).alias("_w"), *keys).agg(*aggregates), keys)


def session(df: DataFrame, time: str, gap: str, aggregates: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Windows of rows that follow each other within the gap (a row exactly one gap later still belongs)."""
    return _flat(df.groupBy(F.session_window(F.col(time).cast("timestamp"), gap).alias("_w"), *keys).agg(*aggregates), keys)


def _flat(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c != "_w" and c not in keys]
    return df.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *rest)


def count_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates over each `size` rows of a key that follow each other."""
    chunk = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size)
    return df.withColumn("chunk", chunk).groupBy(*keys, "chunk").agg(*aggregates)


def last_rows(keys: Sequence[str], order: Sequence[str], size: int):
    """Window over a row and the `size - 1` before it."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, Window.currentRow)


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap: str, order: Sequence[str] = ()) -> DataFrame:
    """Numbers each row's session within its key, from 0."""
    w = Window.partitionBy(*keys).orderBy(time, *order)
    new = F.coalesce(F.col(time) > F.lag(time).over(w) + F.expr(f"INTERVAL {gap}"), F.lit(False))
    return df.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def late_split(df: DataFrame, time: str, arrival: str, delay: str, keys: Sequence[str] = (), spans: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows later than the greatest time seen before them less the delay (watermark and lateness together).

    Arrival order is a total order; it is taken within keys (a partition of a
    source), since each partition of a stream has a watermark of its own. A key
    (without keys: everything) may hold any share of the rows: arrivals are cut
    into `spans` by quantiles, each span's greatest time goes to those after it
    (`spans` rows a key), and only rows of one span are ordered together.
    Arrivals are numbers or times.
    """
    at = F.col(arrival).cast("timestamp").cast("double") if dict(df.dtypes)[arrival].startswith(("timestamp", "date")) else F.col(arrival).cast("double")
    cuts = df.select(at.alias("_a")).approxQuantile("_a", [i / spans for i in range(1, spans)], 0.25 / spans)
    cut = df.withColumn("_span", sum((F.when(at >= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)))
    ahead = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    greatest = cut.groupBy(*keys, "_span").agg(F.max(time).alias("_m")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_span").alias("_s"), F.max("_m").over(ahead).alias("_m"))
    joined = cut.join(greatest, [F.col("_span") == F.col("_s"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)])
    before = Window.partitionBy(*keys, "_span").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max(time).over(before), F.col("_m"))
    judged = joined.withColumn("_late", F.coalesce(F.col(time) < seen - F.expr(f"INTERVAL {delay}"), F.lit(False))).select(*df.columns, "_late")
    return judged.where(~F.col("_late")).drop("_late"), judged.where("_late").drop("_late")


# -- aggregates -------------------------------------------------------------------
def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_if(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def avg_if(value: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, value))


def min_if(value: Column, condition: Column) -> Column:
    return F.min(F.when(condition, value))


def max_if(value: Column, condition: Column) -> Column:
    return F.max(F.when(condition, value))


def first_value_by(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def last_value_by(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def collect_ordered(value: Column, order: Column) -> Column:
    """All values of a group in order (for the first few of a large group see first_values)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda p: p["v"])


def string_agg(value: Column, separator: str) -> Column:
    """Values in ascending order, joined."""
    return F.concat_ws(separator, F.array_sort(F.collect_list(value)))


def percentile(value: Column, p: float) -> Column:
    """p from 0 to 100, exact."""
    return F.percentile(value, p / 100)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first `k` rows of each key, with their rank (Spark keeps only k rows of a group before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def first_values(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column], k: int, into: str = "values") -> DataFrame:
    """For each key the values of its first `k` rows, in order; nulls are passed over. No task keeps more than k rows of a key.

    order: Columns, or pairs (Column, descending).
    """
    plain = df.select(*keys, value.alias("_v"), *(o.alias(f"_o{i}") for i, (o, _) in enumerate(_ordered(order)))).where("_v IS NOT NULL")
    by = [F.col(f"_o{i}").desc() if down else F.col(f"_o{i}").asc() for i, (_, down) in enumerate(_ordered(order))]
    few = top_k(plain, keys, by, k)
    listed = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "_v"))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["_v"]).alias(into))


def _ordered(order: Sequence) -> list[tuple[Column, bool]]:
    return [o if isinstance(o, tuple) else (o, False) for o in order]


def top_values(df: DataFrame, keys: Sequence[str], value: Column, k: int, into: str = "top") -> DataFrame:
    """For each key its k greatest values, greatest first."""
    return first_values(df, keys, value, [(value, True)], k, into)


def latest_by(value: Column, offset: Column) -> Column:
    return F.max_by(value, offset)


def running(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def within(keys: Sequence[str], time: str, seconds: int):
    """Window over the rows of a key in the last `seconds`, the row itself included."""
    return Window.partitionBy(*keys).orderBy(F.unix_seconds(F.col(time).cast("timestamp"))).rangeBetween(-seconds, 0)


def distinct_within(value: str, window) -> Column:
    return F.size(F.collect_set(value).over(window))


def aggregate_with_missing(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Joins the branches' results by key and names the branches that gave none."""
    out: DataFrame | None = None
    for name, part in parts.items():
        part = part.withColumn(f"_has_{name}", F.lit(True))
        out = part if out is None else out.join(part, list(keys), "full")
    missing = F.array_compact(F.array(*(F.when(F.col(f"_has_{n}").isNull(), F.lit(n)) for n in parts)))
    return out.withColumn("missing", missing).drop(*(f"_has_{n}" for n in parts))
