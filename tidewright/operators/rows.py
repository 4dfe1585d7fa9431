"""Operators on single rows: project, filter, route, validate, branch, merge, fan out, dedupe."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(df: DataFrame, *fields: str) -> DataFrame:
    return df.select(*fields)


def project_except(df: DataFrame, *fields: str) -> DataFrame:
    return df.drop(*fields)


# -- two-valued logic: a comparison with a null is false, and NOT makes it true --
def two_valued(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def like(value: Column, pattern: str) -> Column:
    """% and _ as usual, letters in either case."""
    return two_valued(value.ilike(pattern))


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Filter in two-valued logic."""
    return df.where(two_valued(predicate))


def assign(df: DataFrame, steps: Sequence[tuple[str, Column]], drop: Sequence[str] = ()) -> DataFrame:
    """Assignments in order, later ones see earlier ones; locals are dropped in the end."""
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop(*drop)


# -- routing --------------------------------------------------------------------
def route(df: DataFrame, condition: Column, column: str = "decision") -> DataFrame:
    """Tags each row, drops none."""
    return df.withColumn(column, F.when(condition, "matched").otherwise("default"))


def split(df: DataFrame, tiers: Sequence[tuple[str, Column]], otherwise: str = "default", column: str = "tier") -> DataFrame:
    """Tags each row with the first tier that holds."""
    tag = F.lit(otherwise)
    for name, condition in reversed(tiers):
        tag = F.when(condition, name).otherwise(tag)
    return df.withColumn(column, tag)


def destinations(df: DataFrame, decision: Column, values: Sequence[str]) -> dict[str, DataFrame]:
    """One frame for each decision value, and `default` for all others."""
    outputs = {v: df.where(decision == v) for v in values}
    outputs["default"] = df.where(~two_valued(decision.isin(list(values))))
    return outputs


# -- validation -----------------------------------------------------------------
@dataclass(frozen=True)
class Check:
    condition: Column
    message: str
    code: str | None = None
    severity: str = "error"
    #: The check is made only where this holds.
    when: Column | None = None

    def failed(self) -> Column:
        bad = ~two_valued(self.condition)
        return bad if self.when is None else two_valued(self.when) & bad


def errors(checks: Sequence[Check]) -> Column:
    """All failing checks of a row, in order, as structs."""
    found = (F.when(c.failed(), F.struct(F.lit(c.message).alias("message"), F.lit(c.code).cast("string").alias("code"), F.lit(c.severity).alias("severity"))) for c in checks)
    return F.array_compact(F.array(*found))


def messages(checks: Sequence[Check]) -> Column:
    return F.transform(errors(checks), lambda e: e["message"])


def validate(df: DataFrame, checks: Sequence[Check], column: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their messages."""
    judged = df.withColumn(column, messages(checks))
    return judged.where(F.size(column) == 0).drop(column), judged.where(F.size(column) > 0)


@dataclass(frozen=True)
class OnError:
    """What becomes of a row whose checks fail: reject, skip, default or raise."""

    action: str = "reject"
    default: dict[str, Column] | None = None


def guard(df: DataFrame, checks: Sequence[Check], handling: OnError) -> tuple[DataFrame, DataFrame]:
    """The rows that go on, and the rows that were set aside."""
    judged = df.withColumn("errors", messages(checks))
    bad = F.size("errors") > 0
    if handling.action == "raise":
        text = F.concat_ws("; ", "errors")
        # in a filter, so that no projection can leave the error out
        return judged.where(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(True)).drop("errors"), judged.where(F.lit(False))
    if handling.action == "default":
        mended = judged
        for name, value in (handling.default or {}).items():
            mended = mended.withColumn(name, F.when(bad, value).otherwise(F.col(name)))
        return mended.drop("errors"), judged.where(F.lit(False))
    good = judged.where(~bad).drop("errors")
    return good, judged.where(bad) if handling.action == "reject" else judged.where(F.lit(False))


def dead_letters(rejected: DataFrame, stage: str, clock: Column | None = None) -> DataFrame:
    """Rejected rows in an envelope: payload, messages, stage, time."""
    payload = F.to_json(F.struct(*(c for c in rejected.columns if c != "errors")))
    return rejected.select(payload.alias("payload"), F.col("errors").alias("messages"), F.lit(stage).alias("stage"), (clock if clock is not None else F.current_timestamp()).alias("failed_at"))


#: What an error policy may say.
POLICIES = ("retry", "skip", "dead_letter", "fail")


def by_error_class(failed: DataFrame, error_class: str, policies: dict[str, str], otherwise: str = "dead_letter") -> dict[str, DataFrame]:
    """Failed rows by what is to be done with them; policies by class of error, "*" in a class stands for any text.

    `fail` raises for the first row that has such a class, when its frame is used.
    """
    unknown = {*policies.values(), otherwise} - {*POLICIES}
    if unknown:
        raise ValueError(f"unknown policies {sorted(unknown)}")
    choice = F.lit(otherwise)
    for pattern, policy in reversed(policies.items()):
        choice = F.when(F.coalesce(F.col(error_class).like(pattern.replace("*", "%")), F.lit(False)), policy).otherwise(choice)
    judged = failed.withColumn("_policy", choice)
    out = {p: judged.where(F.col("_policy") == p).drop("_policy") for p in POLICIES}
    text = F.concat(F.lit("failed: "), F.coalesce(F.col(error_class), F.lit("no class")))
    out["fail"] = judged.where(F.when(F.col("_policy") == "fail", F.raise_error(text).cast("boolean")).otherwise(False)).drop("_policy")
    return out


# -- branches -------------------------------------------------------------------
Step = Callable[[DataFrame], DataFrame]


def branch(df: DataFrame, condition: Column, step: Step) -> DataFrame:
    """Rows that hold go through the step, the others by it; the step keeps the columns."""
    held = two_valued(condition)
    return step(df.where(held)).unionByName(df.where(~held))


def parallel(df: DataFrame, branches: dict[str, Step], name: str | None = None) -> DataFrame:
    """Every row goes to every branch; what they give is put together."""
    outputs = [step(df) if name is None else step(df).withColumn(name, F.lit(label)) for label, step in branches.items()]
    return merge(*outputs)


def min_required(df: DataFrame, keys: Sequence[str], branch_column: str, least: int) -> DataFrame:
    """Keys that came through `least` branches or more."""
    return df.groupBy(*keys).agg(F.countDistinct(branch_column).alias("branches")).where(F.col("branches") >= least)


def parallel_required(df: DataFrame, branches: dict[str, Step], keys: Sequence[str], name: str = "branch", require_all: bool = True, least: int = 1) -> DataFrame:
    """As parallel, of keys that came through every branch (`require_all`) or through `least` of them.

    A bounded job has no clock to time a branch out by: a branch that gives nothing for a key is what a timeout would leave.
    """
    out = parallel(df, branches, name)
    through = min_required(out, keys, name, len(branches) if require_all else least).drop("branches")
    return out.join(through, list(keys), "left_semi")


def merge(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, copies included; columns go by name."""
    return reduce(lambda a, b: a.unionByName(b), inputs)


def fan_out(df: DataFrame, *records: Column, keep_columns: Sequence[str] = ()) -> DataFrame:
    """One row becomes as many rows as there are records."""
    return df.select(*keep_columns, F.explode(F.array(*records)).alias("_r")).select(*keep_columns, "_r.*")


# -- annotations ------------------------------------------------------------------
def add_flag(df: DataFrame, flag: str, when: Column, column: str = "flags") -> DataFrame:
    have = F.coalesce(F.col(column), F.array().cast("array<string>")) if column in df.columns else F.array().cast("array<string>")
    return df.withColumn(column, F.when(two_valued(when), F.array_append(have, F.lit(flag))).otherwise(have))


def add_metadata(df: DataFrame, key: str, value: Column, column: str = "metadata") -> DataFrame:
    new = F.create_map(F.lit(key), value.cast("string"))
    return df.withColumn(column, F.map_concat(F.map_filter(F.col(column), lambda k, _: k != key), new) if column in df.columns else new)


def adjust_score(df: DataFrame, by: Column, column: str = "score") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(0)) + by)


def audit_events(df: DataFrame, event: str, actor: Column, payload: Sequence[str], clock: Column) -> DataFrame:
    """One audit row for every row."""
    return df.select(F.lit(event).alias("event"), actor.alias("actor"), F.to_json(F.struct(*payload)).alias("payload"), clock.alias("at"))


def completion_events(df: DataFrame, target: str, correlation: str, include: Sequence[str]) -> DataFrame:
    """One completion row for every written row: correlation id, target, included fields."""
    return df.select(F.col(correlation).alias("correlation_id"), F.lit(target).alias("target"), F.lit("committed").alias("status"), *include)


def due(df: DataFrame, at: str, after: str, action: str, repeat_until: Column | None = None) -> DataFrame:
    """Scheduled work: when it is due and what is to be done."""
    out = df.withColumn("due_at", F.col(at) + F.expr(f"INTERVAL {after}")).withColumn("action", F.lit(action))
    return out if repeat_until is None else out.withColumn("repeats", ~two_valued(repeat_until))


# -- duplicates -----------------------------------------------------------------
def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_in_window(df: DataFrame, keys: Sequence[str], time: str, window: str, order: Sequence[str | Column] = ()) -> DataFrame:
    """Rows without another one of their key in the `window` before them."""
    w = Window.partitionBy(*keys).orderBy(time, *order)
    return df.withColumn("_p", F.lag(time).over(w)).where(F.col("_p").isNull() | (F.col(time) > F.col("_p") + F.expr(f"INTERVAL {window}"))).drop("_p")
