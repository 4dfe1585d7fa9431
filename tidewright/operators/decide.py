"""Decision tables and procedural rules, compiled to expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _true_if(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# -- cells: each takes the column that it judges; a null fails unless the cell says otherwise --
def anything(_: Column) -> Column:
    return F.lit(True)


def exact(value):
    return lambda c: c.isNull() if value is None else _true_if(c == value)


def span(low, high):
    """low to high, both in."""
    return lambda c: _true_if(c.between(low, high))


def one_of(*values):
    return lambda c: _true_if(c.isin(*values))


def none_of(*values):
    """A null is not in the list, so it passes."""
    return lambda c: ~_true_if(c.isin(*values))


def full_match(pattern: str):
    return lambda c: _true_if(c.rlike(f"^(?:{pattern})$"))


def starts(prefix: str):
    return lambda c: _true_if(c.startswith(prefix))


def ends(suffix: str):
    return lambda c: _true_if(c.endswith(suffix))


def holds(part: str):
    return lambda c: _true_if(c.contains(part))


def missing(c: Column) -> Column:
    return c.isNull()


def present(c: Column) -> Column:
    return c.isNotNull()


def less(v):
    return lambda c: _true_if(c < v)


def at_most(v):
    return lambda c: _true_if(c <= v)


def more(v):
    return lambda c: _true_if(c > v)


def at_least(v):
    return lambda c: _true_if(c >= v)


def unlike(v):
    """A null is unlike every value."""
    return lambda c: ~c.eqNullSafe(v)


def chain(first, *rest: tuple[str, object]):
    """Cells joined from left to right, AND and OR without precedence."""

    def judged(c: Column) -> Column:
        out = first(c)
        for word, cell in rest:
            out = (out & cell(c)) if word == "and" else (out | cell(c))
        return out

    return judged


@dataclass(frozen=True)
class Row:
    """Cells by column name (missing: anything), results by output name, and a priority for collected hits."""

    given: dict[str, object]
    result: dict[str, Column]
    priority: int = 0


@dataclass(frozen=True)
class DecisionTable:
    rows: Sequence[Row]
    #: Types of the outputs, in order.
    outputs: dict[str, str]
    name: str = "table"

    def __post_init__(self):
        for i, r in enumerate(self.rows):
            unknown = set(r.result) - set(self.outputs)
            if unknown:
                raise ValueError(f"{self.name}, row {i + 1}: results {sorted(unknown)} are not outputs")

    def hit(self, row: Row) -> Column:
        return reduce(lambda a, b: a & b, (cell(F.col(c)) for c, cell in row.given.items()), F.lit(True))

    def _record(self, row: Row) -> Column:
        return F.struct(*(F.coalesce(row.result.get(o, F.lit(None)), F.lit(None)).cast(t).alias(o) for o, t in self.outputs.items()))

    def first_match(self) -> Column:
        """The first hit's results; null without a hit."""
        out = None
        for row in self.rows:
            out = F.when(self.hit(row), self._record(row)) if out is None else out.when(self.hit(row), self._record(row))
        return out

    def hits(self) -> Column:
        """All hits' results in row order."""
        return F.array_compact(F.array(*(F.when(self.hit(r), self._record(r)) for r in self.rows)))

    def by_priority(self) -> Column:
        """All hits' results, highest priority first, then row order."""
        ordered = sorted(self.rows, key=lambda r: -r.priority)
        return F.array_compact(F.array(*(F.when(self.hit(r), self._record(r)) for r in ordered)))

    def hit_count(self) -> Column:
        return reduce(lambda a, b: a + b, (self.hit(r).cast("int") for r in self.rows))

    def single_hit(self, strict: bool = False) -> Column:
        """The only hit's results; null (or an error) with none or several."""
        one = F.when(self.hit_count() == 1, self.first_match())
        if not strict:
            return one
        text = F.when(self.hit_count() == 0, f"{self.name}: no row matches").otherwise(f"{self.name}: several rows match")
        return F.when(self.hit_count() == 1, self.first_match()).otherwise(F.raise_error(text))

    def apply(self, df: DataFrame, policy: str = "first", into: str | None = None) -> DataFrame:
        """Adds the outputs as columns (first, single), or a list of structs under `into` (multi, collect)."""
        if policy in ("multi", "collect"):
            return df.withColumn(into or "hits", self.hits() if policy == "multi" else self.by_priority())
        record = self.first_match() if policy == "first" else self.single_hit()
        tagged = df.withColumn("_r", record)
        return tagged.select(*df.columns, *(F.col(f"_r.{o}").alias(o) for o in self.outputs))


def exact_table(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """A table of exact cells with more rows than a chain should have: a null-safe join (Spark broadcasts a small table)."""
    side = table.select(*(F.col(c).alias(f"_t_{c}") for c in on), *(c for c in table.columns if c not in on))
    return df.join(side, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in on)), "left").drop(*(f"_t_{c}" for c in on))


# -- procedural rules -------------------------------------------------------------
@dataclass(frozen=True)
class Set:
    name: str
    value: Column


@dataclass(frozen=True)
class Act:
    """A named action; its name is appended to the action list."""

    name: str


#: The catalogue of actions, by category.
ACTIONS = {
    "application_processing": ("reject_application", "approve_application", "instant_approval", "conditional_approval", "manual_review", "require_manual_review"),
    "transaction_authorization": ("approve_transaction", "block_transaction", "decline", "temporary_block"),
    "risk_management": ("flag_for_review", "require_verification", "require_phone_verification", "require_step_up_auth", "require_additional_auth"),
    "communication": ("send_alert", "send_sms_verification", "send_real_time_alert"),
    "account_management": ("increase_credit_limit", "decrease_credit_limit"),
}


def act(name: str) -> Act:
    """An action of the catalogue, by its name in snake_case or camelCase."""
    snake = "".join(f"_{c.lower()}" if c.isupper() and not (i and name[i - 1].isupper()) else c.lower() for i, c in enumerate(name))
    if not any(snake in names for names in ACTIONS.values()):
        raise KeyError(f"no action named {name!r}")
    return Act(snake)


def action_requests(df: DataFrame, keys: Sequence[str], context: Sequence[str] = (), actions: str = "actions") -> DataFrame:
    """One row for each action that a procedure has listed: keys, place, action, its category (null outside the catalogue), and the context as JSON."""
    table = F.create_map(*(F.lit(x) for category, names in ACTIONS.items() for n in names for x in (n, category)))
    payload = F.to_json(F.struct(*context)) if context else F.lit(None).cast("string")
    return df.select(*keys, payload.alias("context"), F.posexplode(actions).alias("place", "action")).select(*keys, "place", "action", F.try_element_at(table, F.col("action")).alias("category"), "context")


@dataclass(frozen=True)
class Return:
    pass


@dataclass(frozen=True)
class If:
    #: (condition, statements) in order, and the statements otherwise.
    branches: Sequence[tuple[Column, Sequence[object]]]
    otherwise: Sequence[object] = ()


def procedure(df: DataFrame, statements: Sequence[object], actions: str = "actions") -> DataFrame:
    """Runs the statements on each row: branches are evaluated where they stand, and nothing runs after a return."""
    out = df.withColumn(actions, F.array().cast("array<string>")).withColumn("_live", F.lit(True))
    counter = iter(range(1 << 30))

    def run(frame: DataFrame, body: Sequence[object], guard: str) -> DataFrame:
        for s in body:
            on = F.col(guard) & F.col("_live")
            if isinstance(s, Set):
                old = F.col(s.name) if s.name in frame.columns else F.lit(None)
                frame = frame.withColumn(s.name, F.when(on, s.value).otherwise(old))
            elif isinstance(s, Act):
                frame = frame.withColumn(actions, F.when(on, F.array_append(actions, F.lit(s.name))).otherwise(F.col(actions)))
            elif isinstance(s, Return):
                frame = frame.withColumn("_live", F.col("_live") & ~on)
            elif isinstance(s, If):
                taken = F.lit(False)
                names = []
                for condition, part in s.branches:
                    name = f"_b{next(counter)}"
                    frame = frame.withColumn(name, on & ~taken & _true_if(condition))
                    names.append((name, part))
                    taken = reduce(lambda a, b: a | b, (F.col(n) for n, _ in names))
                last = f"_b{next(counter)}"
                frame = frame.withColumn(last, on & ~taken)
                for name, part in [*names, (last, s.otherwise)]:
                    frame = run(frame, part, name)
            else:
                raise TypeError(f"not a statement: {s!r}")
        return frame

    done = run(out.withColumn("_all", F.lit(True)), statements, "_all")
    return done.drop("_all", "_live", *(c for c in done.columns if c.startswith("_b") and c[2:].isdigit()))
