"""Keyed state over bounded data: counters, buffers, state machines, markers and phases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "counter", by: Column | None = None) -> DataFrame:
    """The key's count (or sum) up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into, F.sum(by if by is not None else F.lit(1)).over(w))


def gauge(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str = "gauge") -> DataFrame:
    """The key's last non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def counter_with_ttl(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], ttl: str, into: str = "counter") -> DataFrame:
    """As counter, but the state ends when a key is quiet for longer than the ttl (which each row renews)."""
    from tidewright.operators.windows import sessions

    numbered = sessions(df, keys, time, ttl, order)
    return counter(numbered, [*keys, "session"], [time, *order], into).drop("session")


def counter_with_absolute_ttl(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], ttl: str, into: str = "counter") -> DataFrame:
    """As counter, but the state ends when the ttl after its first row has passed, whatever comes meanwhile. Rows without a time are left out."""
    from tidewright.operators.correlate import hold_window

    lives = hold_window(df, keys, time, order, ttl)
    return counter(lives, [*keys, "buffer"], [time, *order], into).drop("buffer", "outcome")


def buffer(df: DataFrame, keys: Sequence[str], order: Sequence[str], record: Column, kind: str = "fifo", priority: Column | None = None) -> DataFrame:
    """All records of a key: fifo (oldest first), lifo (newest first), priority (highest first, then oldest)."""
    if kind == "priority":
        w = Window.partitionBy(*keys).orderBy(priority.desc(), *order)
    else:
        w = Window.partitionBy(*keys).orderBy(*(F.col(o).desc() if kind == "lifo" else F.col(o).asc() for o in order))
    numbered = df.withColumn("_n", F.row_number().over(w)).select(*keys, F.struct(F.col("_n").alias("n"), record.alias("r")).alias("_x"))
    listed = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["r"]).alias("buffer"))


@dataclass(frozen=True)
class StateMachine:
    """States and allowed moves; "*" stands for any state it comes from."""

    initial: str
    moves: dict[str, Sequence[str]]
    states: Sequence[str] = ()
    final: Sequence[str] = field(default=())

    def __post_init__(self):
        known = {*self.states, self.initial}
        used = {s for s in self.moves if s != "*"} | {t for ts in self.moves.values() for t in ts}
        if self.states and used - known:
            raise ValueError(f"unknown states {sorted(used - known)}")

    def allowed(self, old: Column, new: Column) -> Column:
        """A null on either side is not allowed; without any moves everything is."""
        if not self.moves:
            return old.isNotNull() & new.isNotNull()
        ok = F.lit(False)
        for source, targets in self.moves.items():
            hit = new.isin(*targets) if targets else F.lit(False)
            ok = ok | (hit if source == "*" else (old == source) & hit)
        return F.coalesce(ok & old.isNotNull() & new.isNotNull(), F.lit(False))

    def check(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, into: str = "valid") -> DataFrame:
        """Whether each row's state follows from the key's previous one; a first row must be in the initial state."""
        previous = F.lag(F.struct(F.col(state).alias("s"))).over(Window.partitionBy(*keys).orderBy(*order))
        first = F.coalesce(F.col(state) == self.initial, F.lit(False))
        return df.withColumn("_p", previous).withColumn(into, F.when(F.col("_p").isNull(), first).otherwise(self.allowed(F.col("_p.s"), F.col(state)))).drop("_p")

    def transitions(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, actions: dict[tuple[str, str], str] | None = None) -> DataFrame:
        """Rows that move their key from one state to another, with `from_state`, `to_state`, `valid` and the `action` of the move.

        actions: names by (from, to), "*" for any state; the exact pair goes before one with a star.
        """
        w = Window.partitionBy(*keys).orderBy(*order)
        moved = self.check(df, keys, order, state).withColumns({"from_state": F.lag(state).over(w), "to_state": F.col(state)})
        moved = moved.where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col("to_state")))
        action = F.lit(None).cast("string")
        for (old, new), name in sorted((actions or {}).items(), key=lambda a: a[0].count("*"), reverse=True):
            hit = (F.lit(True) if old == "*" else F.col("from_state") == old) & (F.lit(True) if new == "*" else F.col("to_state") == new)
            action = F.when(hit & F.col("valid"), name).otherwise(action)
        return moved.withColumn("action", action)

    def is_final(self, state: Column) -> Column:
        ends = [s for s in {*self.states, *self.final, self.initial, *(t for ts in self.moves.values() for t in ts)} if s in self.final or not self.moves.get(s)]
        return F.coalesce(state.isin(*ends), F.lit(False))


# -- markers and phases -----------------------------------------------------------
def marker_at_count(df: DataFrame, name: str, order: Sequence[str], least: int, condition: Column) -> DataFrame:
    """When the `least`-th row that holds came: one row (marker, at), empty if it never did.

    Only the `least` first such rows are looked at (a top-k, kept small in every task).
    """
    top = df.where(condition).select(*order).orderBy(*order).limit(least)
    return top.groupBy().agg(F.count("*").alias("n"), F.max(order[0]).alias("at")).where(F.col("n") >= least).select(F.lit(name).alias("marker"), "at")


def marker_at_signal(df: DataFrame, name: str, time: str, condition: Column) -> DataFrame:
    """When the signal first came."""
    return df.where(condition).agg(F.min(time).alias("at")).where(F.col("at").isNotNull()).select(F.lit(name).alias("marker"), "at")


def marker_when_drained(df: DataFrame, name: str, time: str, gap: str, spans: str = "1 hour") -> DataFrame:
    """When the stream had first been quiet for the gap (its last row counts): one row (marker, at).

    Rows are cut into spans of time; a span passes on its last time to the next
    one, so only rows of one span are ordered together.
    """
    at = F.col(time).cast("timestamp")
    cut = df.where(at.isNotNull()).select(F.col(time).alias("t"), F.window(at, spans)["start"].alias("s"))
    inside = cut.withColumn("n", F.lead("t").over(Window.partitionBy("s").orderBy("t")))
    first = cut.groupBy("s").agg(F.min("t").alias("f"))  # one row a span
    ahead = first.select("s", F.lead("f").over(Window.orderBy("s")).alias("a"))
    following = inside.join(ahead, "s").withColumn("n", F.coalesce("n", "a"))
    quiet = following.where(F.col("n").isNull() | (F.col("n") > F.col("t") + F.expr(f"INTERVAL {gap}")))
    return quiet.agg(F.min("t").alias("t")).where("t IS NOT NULL").select(F.lit(name).alias("marker"), (F.col("t") + F.expr(f"INTERVAL {gap}")).alias("at"))


def marker_after(markers: DataFrame, name: str, other: str, delay: str) -> DataFrame:
    """Fires a delay after another marker."""
    return markers.where(F.col("marker") == other).agg(F.min("at").alias("at")).where("at IS NOT NULL").select(F.lit(name).alias("marker"), (F.col("at") + F.expr(f"INTERVAL {delay}")).alias("at"))


def marker_of(markers: DataFrame, name: str, others: Sequence[str], every: bool = True) -> DataFrame:
    """Fires when every one (`and`) or the first one (`or`) of some markers has."""
    first = markers.where(F.col("marker").isin(*others)).groupBy("marker").agg(F.min("at").alias("at"))
    both = first.agg(F.count("*").alias("n"), (F.max if every else F.min)("at").alias("at"))
    return both.where(F.col("n") >= (len(set(others)) if every else 1)).select(F.lit(name).alias("marker"), "at")


def phase(df: DataFrame, time: str, markers: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Rows at or after one marker and before another; a marker that never fired lets nothing after it, and everything before it."""
    for name, is_start in ((after, True), (before, False)):
        if name is not None:
            at = markers.where(F.col("marker") == name).agg(F.min("at")).scalar()
            df = df.where(F.col(time) >= at) if is_start else df.where(at.isNull() | (F.col(time) < at))
    return df


def with_markers(df: DataFrame, time: str, markers: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds `fired_<name>` for each marker: whether it had fired by the row's time. Cells of a decision table can judge these."""
    at = {n: markers.where(F.col("marker") == n).agg(F.min("at")).scalar() for n in names}
    return df.withColumns({f"fired_{n}": F.coalesce(F.col(time) >= at[n], F.lit(False)) for n in names})


def poison(df: DataFrame, keys: Sequence[str], time: str, failed: Column, times: int, seconds: int, into: str = "poison") -> DataFrame:
    """Whether a key has failed `times` times within the last `seconds`."""
    w = Window.partitionBy(*keys).orderBy(F.unix_seconds(F.col(time).cast("timestamp"))).rangeBetween(-seconds, 0)
    return df.withColumn(into, F.count_if(failed).over(w) >= times)
