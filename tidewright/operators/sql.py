"""Embedded SQL over named frames, and row patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def sql(text: str, **frames: DataFrame) -> DataFrame:
    """Runs SQL over frames by name; the names are bound to this query alone, no view is left behind."""
    if not frames:
        raise ValueError("name at least one frame")
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(_braced(text, frames), **frames)


def _braced(text: str, frames: dict[str, DataFrame]) -> str:
    """Writes {name} where a frame's name stands as a table after FROM or JOIN."""
    names = "|".join(map(re.escape, frames))
    return re.sub(rf"(?i)\b(FROM|JOIN)\s+({names})\b", r"\1 {\2}", text)


def match_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], define: dict[str, Column], pattern: str) -> DataFrame:
    """Row patterns: one row for each match, leftmost and greedy, going on after the last matched row.

    `define` maps single letters to conditions (the first that holds names the
    row, others are "."); `pattern` is a regular expression over letters. Gives
    keys, match number, first and last position (from 0) in the key's order and
    the letters. Join back by position (see numbered) for measures.
    """
    for letter in define:
        if len(letter) != 1 or not letter.isalpha():
            raise ValueError("symbols are single letters")
    symbol = F.lit(".")
    for letter, condition in reversed(define.items()):
        symbol = F.when(condition, letter).otherwise(symbol)
    # the key's rows become one short text of letters, so only letters are gathered
    pairs = df.select(*keys, F.struct(*order, symbol.alias("_s")).alias("_x")).groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_l"))
    letters = pairs.select(*keys, F.array_join(F.transform("_l", lambda x: x["_s"]), "").alias("_letters"))
    wanted = re.compile(pattern)
    schema = StructType([*(letters.schema[k] for k in keys), StructField("match_number", LongType()), StructField("first_row", LongType()), StructField("last_row", LongType()), StructField("letters", StringType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                found = (m for m in wanted.finditer(r[-1]) if m.end() > m.start())
                rows += [(*r[:-1], n, m.start(), m.end() - 1, m[0]) for n, m in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return letters.mapInPandas(run, schema)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "row") -> DataFrame:
    """Position of each row in its key's order, from 0."""
    from pyspark.sql import Window

    return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
