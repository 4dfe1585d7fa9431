"""Sharding by sampled splitters, with DataFrame functions only.

Rows of one id, size and text hash are one record with a number of copies, so
that any number of them can be placed by counting.  Every record gets a 53-bit
key (exact as a double, which quantiles are made of): the CRC-32 of its text, then a hash of its id, so that equal texts are
neighbours and a large group of copies can still be cut.  Keys are drawn as
often as their size asks for; quantiles of the draws are the boundaries of
ranges, to which records are dealt by binary search; ranges that turn out
overfull are subdivided along the key.  Offsets of the ranges and of their
pieces, and running sums inside a piece, give each row its place in bytes, and
the place gives the shard.

The law is `bytes`: a shard's size differs from the mean by less than one
record.  Defined results: a null text has size 1 and CRC 0, as an empty one;
null ids are ordinary records; of repeated rows each has its own slot; a very
long text is drawn more than once and may be a range by itself; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.ranges import rank_in
from tidewright.llm.store import cut

SHARDS = 8
#: Bytes that a range should hold, least and most number of ranges, draws for each range; copies that are told apart at once.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES, SAMPLED, AT_ONCE = 32 << 20, 64, 4096, 48, 1 << 16
SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, CRC, key and number of copies of every record."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    records = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    return records.withColumn("key", F.shiftleft("text_crc32", 21) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 21)))


def drawn(weight: Column, total: int, draws: int, *identity: str) -> Column:
    """How often a row of that weight is drawn if all rows together are drawn about `draws` times: its share, rounded by a hash of its identity."""
    share = weight * (draws / max(total, 1))
    chance = F.pmod(F.xxhash64(*identity, F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    return (F.floor(share) + (chance < share - F.floor(share)).cast("long")).cast("int")


def quantiles(drawn_keys: DataFrame, key: str, ranges: int) -> list[int]:
    """Boundaries (ranges - 1 at most) between equal shares of the draws; `draws` tells how often a key was drawn."""
    if ranges < 2:
        return []
    wanted = ",".join(str(i / ranges) for i in range(1, ranges))
    sample = drawn_keys.where("draws > 0").select(F.explode(F.array_repeat(key, F.col("draws"))).alias(key))
    return sorted(set(sample.agg(F.expr(f"percentile_approx({key}, array({wanted}), 20000)").alias("b")).first()["b"] or []))


def splitters(records: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of keys."""
    draws = drawn(F.col("size") * F.col("copies"), total, SAMPLED * ranges, "doc_id", "text_crc32")
    return quantiles(records.select("key", draws.alias("draws")), "key", ranges)


def ranged(records: DataFrame, total: int, ranges: int) -> DataFrame:
    """Adds `range` and `piece`: the range by splitters, and an overfull range's subdivision along its keys."""
    place = rank_in(F.col("key"), splitters(records, total, ranges)).cast("int")
    of = records.select("*", F.explode(F.array(place)).alias("range"))  # a generated column: the optimizer infers nothing about it in the joins below
    cap = max(1, math.ceil(total / ranges))
    spans = of.groupBy("range").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"))
    spans = spans.select("range", "least", "most", F.when(F.col("bytes") > 2 * cap, F.ceil(F.col("bytes") / cap)).otherwise(1).alias("pieces"))
    along = (F.col("key") - F.col("least")).cast("double") / ((F.col("most") - F.col("least")).cast("double") + 1)
    # one row for each of at most MOST_RANGES ranges: a proven bound
    return of.join(F.broadcast(spans), "range").withColumn("piece", F.least(F.floor(along * F.col("pieces")), F.col("pieces") - 1).cast("int")).drop("least", "most", "pieces")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every record; shard sizes in bytes are equal but for one record."""
    records = cut(sized(docs))
    total = records.agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    ranges = min(MOST_RANGES, max(LEAST_RANGES, math.ceil(total / RANGE_BYTES)))
    cells = ranged(records, total, ranges)
    cell = ["range", "piece"]
    sums = cells.groupBy(*cell).agg(F.sum(F.col("size") * F.col("copies")).alias("cell_bytes"), F.sum("copies").alias("cell_rows"))
    before = Window.partitionBy("range").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.select(*cell, *(F.coalesce(F.sum(f"cell_{x}").over(before), F.lit(0)).alias(f"{x}_in_range") for x in ("bytes", "rows")))
    # ranges are few by construction, so one ordered window over them is small
    whole = sums.groupBy("range").agg(F.sum("cell_bytes").alias("b"), F.sum("cell_rows").alias("r"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("range", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("r0"))
    offsets = inside.join(F.broadcast(starts), "range").select(*cell, (F.col("b0") + F.col("bytes_in_range")).alias("bytes_before"), (F.col("r0") + F.col("rows_in_range")).alias("rows_before"))
    order = Window.partitionBy(*cell).orderBy("key", "doc_id", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / AT_ONCE))
    in_block = F.sequence(F.col("block") * AT_ONCE, F.least(F.col("copies"), (F.col("block") + 1) * AT_ONCE) - 1)
    placed = (
        cells.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
        .withColumn("nth", F.coalesce(F.sum("copies").over(before), F.lit(0)))
        .join(F.broadcast(offsets), cell)  # at most 3 cells for a range on average, 4096 ranges: a proven bound
        .select("*", F.explode(blocks).alias("block"))
        .select("doc_id", "size", "text_crc32", (F.col("bytes_before") + F.col("ahead")).alias("start"), (F.col("rows_before") + F.col("nth")).alias("first"), F.explode(in_block).alias("copy"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.floor((2 * (F.col("start") + F.col("copy") * F.col("size")) + F.col("size")) * shards / (2 * total)), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("first") + F.col("copy")).alias("rank"),
        )
    )
    placed = cut(placed)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
