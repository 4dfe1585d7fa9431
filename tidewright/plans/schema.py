"""Declared schemas: types, constraints, computed fields, versions, migrations, reference entries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidewright.operators.rows import Check

#: Types by their declared names.
TYPES = {
    "string": "string", "text": "string", "uuid": "string", "integer": "bigint", "number": "bigint", "boolean": "boolean", "date": "date", "bizdate": "date",
    "timestamp": "timestamp", "bytes": "binary", "decimal": "decimal(38,10)", "money": "decimal(38,10)", "percentage": "decimal(38,10)",
}
_UUID = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False
    default: object = None
    low: object = None
    high: object = None
    length: int | tuple[int, int] | None = None
    pattern: str | None = None
    values: Sequence[object] = ()
    precision: tuple[int, int] | None = None
    pii: str | None = None

    def spark_type(self) -> str:
        if self.precision and self.kind in ("decimal", "money", "percentage"):
            return f"decimal({self.precision[0]},{self.precision[1]})"
        return TYPES.get(self.kind, self.kind)

    def checks(self) -> list[Check]:
        """What a value must be; a null passes all but `required`."""
        c, out = F.col(self.name), []
        if self.required:
            out.append(Check(c.isNotNull(), f"{self.name} is required", "required"))
        here = c.isNotNull()
        if self.low is not None:
            out.append(Check(c >= F.lit(self.low), f"{self.name} is below {self.low}", "range", when=here))
        if self.high is not None:
            out.append(Check(c <= F.lit(self.high), f"{self.name} is above {self.high}", "range", when=here))
        if self.length is not None:
            low, high = (self.length, self.length) if isinstance(self.length, int) else self.length
            out.append(Check(F.length(c).between(low, high), f"{self.name} has a wrong length", "length", when=here))
        pattern = self.pattern or (_UUID if self.kind == "uuid" else None)
        if pattern:
            out.append(Check(c.rlike(f"^(?:{pattern})$"), f"{self.name} does not match", "pattern", when=here))
        if self.values:
            out.append(Check(c.isin(list(self.values)), f"{self.name} is not an allowed value", "values", when=here))
        return out


@dataclass(frozen=True)
class Schema:
    name: str
    fields: Sequence[Field]
    version: str = "1.0.0"
    key: Sequence[str] = ()
    time: str | None = None
    watermark: str | None = None
    computed: dict[str, Column] = field(default_factory=dict)
    constraints: Sequence[Check] = ()

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: a field is declared twice")
        if len(self.version.split(".")) != 3 or not all(p.isdigit() for p in self.version.split(".")):
            raise ValueError(f"{self.name}: version {self.version!r} is not major.minor.patch")
        for n in (*self.key, *([self.time] if self.time else ())):
            if n not in names:
                raise ValueError(f"{self.name}: {n} is not a field")

    def struct(self) -> StructType:
        return StructType([StructField(f.name, _parse_datatype_string(f.spark_type()), True) for f in self.fields])

    def checks(self) -> list[Check]:
        return [c for f in self.fields for c in f.checks()] + list(self.constraints)

    def conform(self, df: DataFrame) -> DataFrame:
        """Declared columns in declared types (what can't be converted is null), defaults filled in, then computed ones."""
        out = []
        for f in self.fields:
            c = F.col(f.name).try_cast(f.spark_type()) if f.name in df.columns else F.lit(None).cast(f.spark_type())
            out.append((F.coalesce(c, F.lit(f.default).cast(f.spark_type())) if f.default is not None else c).alias(f.name))
        done = df.select(*out)
        for name, value in self.computed.items():
            done = done.withColumn(name, value)
        return done

    def streamed(self, df: DataFrame) -> DataFrame:
        return df.withWatermark(self.time, self.watermark) if self.time and self.watermark else df

    def compatible(self, other: str, mode: str = "backward") -> bool:
        """backward: same major, other minor not above; forward: not below; full: same major; none: equal."""
        mine, its = (tuple(map(int, v.split("."))) for v in (self.version, other))
        if mode == "none":
            return mine == its
        if mine[0] != its[0]:
            return False
        return {"backward": its[1] <= mine[1], "forward": its[1] >= mine[1], "full": True}[mode]

    def migrate(self, df: DataFrame, from_version: str, mapping: dict[str, Column | str]) -> DataFrame:
        """Rows of an older minor version of the same major: mapped fields, else the same name, else null."""
        mine, its = (tuple(map(int, v.split("."))) for v in (self.version, from_version))
        if mine[0] != its[0] or its[1] >= mine[1]:
            raise ValueError(f"{self.name}: no migration from {from_version} to {self.version}")
        out = []
        for f in self.fields:
            source = mapping.get(f.name, f.name if f.name in df.columns else F.lit(None))
            out.append((F.col(source) if isinstance(source, str) else source).cast(f.spark_type()).alias(f.name))
        return df.select(*out)


def divide(a: Column, b: Column, scale: int) -> Column:
    """Decimal division at the dividend's scale, half up."""
    return F.round(F.try_divide(a, b), scale)


def entries(spark: SparkSession, rows: Sequence[tuple], schema: str, deprecated: Sequence[str] = (), key: str = "code") -> DataFrame:
    """A table of reference entries, each with its deprecation."""
    df = spark.createDataFrame(list(rows), schema)
    return df.withColumn("deprecated", F.col(key).isin(list(deprecated)) if deprecated else F.lit(False))
