"""Outside stores as data sources: keyed stores through a client, streaming state, document stores by options."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _client(options: dict[str, str]):
    """The client named by `client` (module:callable), made with the options."""
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


class KeyedReader(DataSourceReader):
    """Scans a store in parts: client.scan(part, parts, batch) gives (key, value) of the part's keys."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.parts = int(self.options.get("parts", "4"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pattern = self.options.get("pattern", "*")
        for key, value in _client(self.options).scan(partition.value, self.parts, int(self.options.get("batch", "1000"))):
            if fnmatchcase(key, pattern):
                yield key, value


class KeyedStreamReader(DataSourceStreamReader):
    """Follows a store's log: client.log(start, end) gives (key, value) of entries [start, end), client.end() the next entry's number.

    The driver asks for numbers alone; the entries of a batch are cut into parts of `batch` entries, read by the tasks.
    """

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"at": int(self.options.get("start", "0"))}

    def latestOffset(self) -> dict:
        return {"at": _client(self.options).end()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        step = max(1, int(self.options.get("batch", "1000")))
        return [InputPartition((at, min(end["at"], at + step))) for at in range(start["at"], end["at"], step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _client(self.options).log(*partition.value)

    def commit(self, end: dict) -> None:
        pass


class KeyedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> KeyedReader:
        return KeyedReader(self.options)

    def streamReader(self, schema) -> KeyedStreamReader:
        return KeyedStreamReader(self.options)


def keyed_scan(spark: SparkSession, client: str, pattern: str = "*", parts: int = 4, batch: int = 1000, **options: str) -> DataFrame:
    """All keys of a store that match the pattern."""
    spark.dataSource.register(KeyedSource)
    return spark.read.format("keyed").options(client=client, pattern=pattern, parts=str(parts), batch=str(batch), **options).load()


def keyed_stream(spark: SparkSession, client: str, start: int = 0, **options: str) -> DataFrame:
    """Entries of a store's log as they come."""
    spark.dataSource.register(KeyedSource)
    return spark.readStream.format("keyed").options(client=client, start=str(start), **options).load()


def stream_state(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The state of a streaming query, as rows of key and value."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint)


def document_options(uri: str, database: str, collection: str, change_stream: bool = False, pipeline: str | None = None) -> dict[str, str]:
    """Options of a document store's connector (which is not part of every installation)."""
    out = {"connection.uri": uri, "database": database, "collection": collection}
    if change_stream:
        out["change.stream.publish.full.document.only"] = "true"
    if pipeline:
        out["aggregation.pipeline"] = pipeline
    return out


def documents(spark: SparkSession, streaming: bool = False, **where) -> DataFrame:
    return (spark.readStream if streaming else spark.read).format("mongodb").options(**document_options(change_stream=streaming, **where)).load()
