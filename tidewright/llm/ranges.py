"""Range helpers built from DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_in(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending `bounds` are <= value: a binary search over one array literal. Null gives 0."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(bounds) + 1)) + 1))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        over = F.get(table, middle) <= value
        open_ = state["low"] < state["high"]
        return F.struct(
            F.when(open_ & over, middle + 1).otherwise(state["low"]).cast("int").alias("low"),
            F.when(open_ & ~F.coalesce(over, F.lit(False)), middle).otherwise(state["high"]).cast("int").alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(steps, start, halve)["low"]
