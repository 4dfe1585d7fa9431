"""Reading: files, streams, ticks, bindings. Bounds and projections stay above the scan, where they are pushed down."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, path: str, columns: Sequence[str] = (), time: str | None = None, since: str | None = None, until: str | None = None, where: Column | None = None, schema: StructType | None = None) -> DataFrame:
    """A Parquet scan with time bounds [since, until], a filter and a projection."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if time and since:
        df = df.where(F.col(time) >= F.lit(since).cast(df.schema[time].dataType))
    if time and until:
        df = df.where(F.col(time) <= F.lit(until).cast(df.schema[time].dataType))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: StructType, delimiter: str = ",", quote: str = '"', escape: str = "\\", header: bool = True, null_value: str = "") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=delimiter, quote=quote, escape=escape, header=header, nullValue=null_value)


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def decode_json(df: DataFrame, column: str, schema: StructType | str, into: str | None = None, rejects: str | None = None) -> DataFrame:
    """Bytes or text to a record; what can't be read becomes null, and is told in `rejects` if asked for."""
    out = df.withColumn(into or column, F.from_json(F.col(column).cast("string"), schema))
    return out.withColumn(rejects, F.col(column).isNotNull() & F.col(into or column).isNull()) if rejects and into else out


def kafka_options(brokers: str, topic: str, group: str | None = None, offset: str = "earliest", isolation: str | None = None, since_ms: int | None = None, limit: int | None = None) -> dict[str, str]:
    """Options of a Kafka source (the connector is not part of every installation)."""
    out = {"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": offset}
    if group:
        out["kafka.group.id"] = group
    if isolation:
        out["kafka.isolation.level"] = isolation
    if since_ms is not None:
        out["startingTimestamp"] = str(since_ms)
    if limit is not None:
        out["maxOffsetsPerTrigger"] = str(limit)
    return out


def kafka(spark: SparkSession, streaming: bool = True, **options) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    return reader.options(**kafka_options(**options)).load()


def ticks(spark: SparkSession, start: str, end: str, every: str) -> DataFrame:
    """A scheduler as a source: one row a tick, both ends in."""
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL {every})) AS tick")


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def keyed(df: DataFrame, keys: Sequence[str], parallelism: int | None = None) -> DataFrame:
    """Partitions by key, where a later operator wants it so."""
    return df.repartition(parallelism, *keys) if parallelism else df.repartition(*keys)


class Bindings:
    """Logical names to places, by environment; ${NAME} and ${NAME:default} come from the environment's variables."""

    def __init__(self, entries: dict[str, dict[str, str]], variables: dict[str, str] | None = None):
        self.entries, self.variables = entries, os.environ if variables is None else variables

    def resolve(self, name: str) -> dict[str, str]:
        if name not in self.entries:
            raise KeyError(f"no binding for {name!r}")
        return {k: self._fill(v) for k, v in self.entries[name].items()}

    def _fill(self, value: str) -> str:
        def put(m: re.Match) -> str:
            name, _, default = m[1].partition(":")
            if name not in self.variables and ":" not in m[1]:
                raise KeyError(f"variable {name} is not set")
            return self.variables.get(name, default)

        return re.sub(r"\$\{([^}]+)\}", put, value)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        options = self.resolve(name)
        fmt, path = options.pop("format", "parquet"), options.pop("path", None)
        reader = spark.read.format(fmt).options(**options)
        return reader.load(path) if path else reader.load()
