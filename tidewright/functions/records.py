"""Records (structs) by path and by schema. Paths are dotted; what they name is known when the plan is made."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def get_or(record: Column, path: str, default) -> Column:
    return F.coalesce(_at(record, path), F.lit(default))


def _at(record: Column, path: str) -> Column:
    for part in path.split("."):
        record = record[part]
    return record


def put(record: Column, path: str, value) -> Column:
    """The record with one field, however deep, set."""
    return record.withField(path, value if isinstance(value, Column) else F.lit(value))


def remove(record: Column, *paths: str) -> Column:
    return record.dropFields(*paths)


def rename(record: Column, old: str, new: str) -> Column:
    return record.withField(new, record[old]).dropFields(old)


def has_field(kind: StructType, path: str) -> bool:
    for part in path.split("."):
        if not isinstance(kind, StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def keys(kind: StructType, deep: bool = False, prefix: str = "") -> list[str]:
    out = []
    for f in kind.fields:
        name = f"{prefix}{f.name}"
        if deep and isinstance(f.dataType, StructType):
            out += keys(f.dataType, True, f"{name}.")
        else:
            out.append(name)
    return out


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Every leaf of every struct column as a column of its own."""
    return df.select(*(F.col(".".join(f"`{p}`" for p in path.split("."))).alias(path.replace(".", separator)) for path in keys(df.schema, deep=True)))


def unflatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Columns whose names share the part before the first separator become one struct."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c.partition(separator)[0], []).append(c)
    return df.select(*(F.col(cs[0]) if len(cs) == 1 and separator not in cs[0] else F.struct(*(F.col(c).alias(c.partition(separator)[2]) for c in cs)).alias(g) for g, cs in groups.items()))


def merge_deep(a: Column, b: Column, a_kind: StructType, b_kind: StructType) -> Column:
    """Fields of both; where both are records they are merged in turn, else b's value counts unless it is null."""
    out = []
    for f in a_kind.fields:
        if f.name not in b_kind.names:
            out.append(a[f.name].alias(f.name))
        elif isinstance(f.dataType, StructType) and isinstance(b_kind[f.name].dataType, StructType):
            out.append(merge_deep(a[f.name], b[f.name], f.dataType, b_kind[f.name].dataType).alias(f.name))
        else:
            out.append(F.coalesce(b[f.name], a[f.name]).alias(f.name))
    return F.struct(*out, *(b[f.name].alias(f.name) for f in b_kind.fields if f.name not in a_kind.names))


def coerce(record: Column, kind: DataType | str) -> Column:
    """Converted field by field; what can't be is null."""
    return F.from_json(F.to_json(record), kind if isinstance(kind, str) else kind.simpleString())


def map_leaves(df: DataFrame, change: Callable[[Column], Column], only: Sequence[str] = ("string",)) -> DataFrame:
    """A change to every leaf of the given types, at any depth."""

    def walk(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*(walk(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return change(c) if kind.simpleString() in only else c

    return df.select(*(walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def field_type(kind: StructType, path: str) -> str | None:
    """Type of a field by path, None if it is not there."""
    for part in path.split("."):
        if not isinstance(kind, StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind.simpleString()


def move(record: Column, old: str, new: str) -> Column:
    return remove(put(record, new, _at(record, old)), old)


def create(**fields: Column) -> Column:
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def values(record: Column, kind: StructType) -> Column:
    """All top-level values, as texts (an array has one type)."""
    return F.array(*(record[n].cast("string") for n in kind.names))


def entries(record: Column, kind: StructType) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("key"), record[n].cast("string").alias("value")) for n in kind.names))


def query(data: Column, path: str) -> Column:
    """What a JSON path finds in a text or a record, as a text."""
    return F.get_json_object(data, path)


def query_first(data: Column, path: str) -> Column:
    """The first of what a JSON path finds; a single finding is its own first."""
    found = F.get_json_object(data, path)
    return F.when(F.startswith(found, F.lit("[")), F.get_json_object(found, "$[0]")).otherwise(found)


def query_paths(kind: StructType, pattern: str) -> list[str]:
    """Dotted paths of leaves that match a pattern, where * stands for one part."""
    wanted = pattern.removeprefix("$.").split(".")
    return [p for p in keys(kind, deep=True) if len(p.split(".")) == len(wanted) and all(w in ("*", x) for w, x in zip(wanted, p.split(".")))]


def reshape(record: Column, shape: dict) -> Column:
    """A record of another shape: names to paths, or to shapes in turn."""
    return F.struct(*((reshape(record, to) if isinstance(to, dict) else _at(record, to)).alias(name) for name, to in shape.items()))


def required_fields(kind: StructType) -> list[str]:
    return [f.name for f in kind.fields if not f.nullable]


def violations(record: Column, kind: StructType) -> Column:
    """Paths of required fields that are null, and of values that can't be what the schema says (given as texts)."""
    found = []
    for f in kind.fields:
        c = record[f.name]
        if not f.nullable:
            found.append(F.when(c.isNull(), F.lit(f"{f.name}: missing")))
        if not isinstance(f.dataType, StructType):
            found.append(F.when(c.isNotNull() & c.try_cast(f.dataType).isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def is_valid(record: Column, kind: StructType) -> Column:
    return F.size(violations(record, kind)) == 0
