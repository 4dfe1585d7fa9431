"""Cutting lineage through the folder that all executors share; sizes and names that operators choose for themselves."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one bucket of an exchange should stand for.
BUCKET_BYTES = 32 << 20


def ready(spark: SparkSession) -> None:
    """See that a checkpoint folder is set: the session's own, or a temporary one where driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there."""
    ready(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0


def buckets_for(docs: DataFrame, size: int) -> int:
    """As many buckets as the session has shuffle partitions, and more where texts of `size` bytes need them."""
    return max(partitions(docs.sparkSession), math.ceil(size / BUCKET_BYTES))


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (whatever its case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
