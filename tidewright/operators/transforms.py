"""Named transforms: mappings, composition, change detection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.rows import Check, messages


@dataclass(frozen=True)
class Transform:
    """Target columns from expressions; `locals_` come first and are dropped; checks before and after."""

    mappings: dict[str, Column]
    locals_: dict[str, Column] | None = None
    before: Sequence[Check] = ()
    after: Sequence[Check] = ()
    name: str = "transform"

    def __post_init__(self):
        if not self.mappings:
            raise ValueError(f"{self.name}: no mappings")

    def __call__(self, df: DataFrame) -> DataFrame:
        """The mapped columns beside all others of the row."""
        own = self.locals_ or {}
        for n, value in own.items():
            df = df.withColumn(n, value)
        return df.withColumns(self.mappings).drop(*own)

    def only(self, df: DataFrame) -> DataFrame:
        """The mapped columns alone."""
        own = self.locals_ or {}
        for n, value in own.items():
            df = df.withColumn(n, value)
        return df.select(*(v.alias(n) for n, v in self.mappings.items()))

    def checked(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that pass all checks, transformed; rows that don't, with their messages."""
        judged = df.withColumn("errors", messages(self.before))
        good, bad = judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)
        done = self(good).withColumn("errors", messages(self.after))
        late = done.where(F.size("errors") > 0)
        return done.where(F.size("errors") == 0).drop("errors"), bad.unionByName(late, allowMissingColumns=True)


def sequential(*steps) -> object:
    """One after another."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


def side_by_side(df: DataFrame, *transforms: Transform) -> DataFrame:
    """All read the same input; each gives a struct named after it."""
    return df.select("*", *(F.struct(*(v.alias(n) for n, v in t.mappings.items())).alias(t.name) for t in transforms))


def conditional(df: DataFrame, branches: Sequence[tuple[Column, Transform]], otherwise: Transform | None = None) -> DataFrame:
    """The first branch that holds maps the row; without one the row stays as it is."""
    names = dict.fromkeys(n for _, t in branches for n in t.mappings) | dict.fromkeys(otherwise.mappings if otherwise else {})
    out = {}
    for n in names:
        old = F.col(n) if n in df.columns else F.lit(None)
        value = otherwise.mappings.get(n, old) if otherwise else old
        for condition, t in reversed(branches):
            value = F.when(condition, t.mappings.get(n, old)).otherwise(value)
        out[n] = value
    return df.withColumns(out)


def on_change(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], into: str = "changed") -> DataFrame:
    """Whether a watched field differs from the key's previous row (a null is a value; the first row has changed)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    record = F.struct(*fields)
    previous = F.lag(record).over(w)
    return df.withColumn(into, previous.isNull() | ~record.eqNullSafe(previous))


def fan_out_records(df: DataFrame, transforms: Sequence[Transform], keep: Sequence[str]) -> DataFrame:
    """One row for each transform, all with the same outputs."""
    records = F.array(*(F.struct(*(v.alias(n) for n, v in t.mappings.items())) for t in transforms))
    return df.select(*keep, F.explode(records).alias("_r")).select(*keep, "_r.*")
