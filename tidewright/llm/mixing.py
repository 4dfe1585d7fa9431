"""Mixing sources to target weights, with DataFrame functions only.

Source token shares are raised to an exponent (temperature) and normalised;
the exponent is bisected until the mixture's entropy reaches a target, or its
largest repetition stays within a limit.  The weights are then realised:
each source's documents are hashed into blocks, every epoch visits the blocks
in its own permuted order, and a source is read until its token budget is
spent, in whole epochs and one partial one.

Only sums over sources reach the driver: each bisection round evaluates, in
one aggregate, all exponents that its next steps could visit.

Defined results: a null source is a source of its own; a null or empty text
counts one token, so that every row can be placed; a very long text is one row
and may spend a budget by itself; repeated rows are rows of their own; an empty
table gives no rows; extra columns are kept, and where one bears the name of a
column that the operator adds, the operator's name is lengthened (`added`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.store import cut, free

#: Blocks of a source at least, documents of a block on average at most; bisection steps of a round and rounds.
BLOCKS, BLOCK_ROWS, STEPS, ROUNDS = 1024, 50_000, 5, 6


def added(columns: list[str]) -> list[str]:
    """Names of the operator's columns beside `columns`: epoch, mix_weight and mix_place unless these are taken."""
    return free(columns, "epoch", "mix_weight", "mix_place")


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected for: entropy (as a share of the most there can be), or repetitions."""

    entropy: float | None = None
    repetition: float | None = 2.0
    #: Tokens of the mixture; None: as many as let every document in once.
    budget: int | None = None


def token_count():
    """Words of the text, at least one."""
    return F.greatest(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("bigint")


def source_tokens(sized: DataFrame) -> DataFrame:
    """One row for each source: its tokens and its share."""
    sums = cut(sized.groupBy("source").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("documents")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    return sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))


def bisect_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent in [0, 1] nearest to 1 (the natural mixture) that meets the target for entropy, or for repetition the one nearest to 0 (an even mixture)."""
    low, high = 0.0, 1.0
    count = sources.count()
    if count < 2:
        return 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / (1 << STEPS) for i in range(1, 1 << STEPS)]
        sums = []
        for i, t in enumerate(grid):
            power = F.pow(F.col("share"), F.lit(t))
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("share") * t).alias(f"l{i}"), F.max(F.pow("share", F.lit(t - 1))).alias(f"m{i}"), F.min(F.pow("share", F.lit(t - 1))).alias(f"n{i}")]
        row = sources.agg(*sums, F.sum("tokens").alias("total")).first()
        at, width = 0, 1 << STEPS
        for _ in range(STEPS):
            middle = at + width // 2
            z, l, m, n = (row[f"{x}{middle - 1}"] for x in "zlmn")
            t = grid[middle - 1]
            if target.entropy is not None:
                enough = math.log(z) - l / z >= target.entropy * math.log(count)
                # entropy falls with the exponent: go up while there is enough
                at = middle if enough else at
            else:
                repeats = m / n if target.budget is None else target.budget * m / (z * row["total"])
                # repetition falls with the exponent: go up while it is too much
                at = middle if repeats > target.repetition else at
            width //= 2
        low, high = low + (high - low) * at / (1 << STEPS), low + (high - low) * (at + 1) / (1 << STEPS)
    return low if target.entropy is not None else high


def plan(sources: DataFrame, target: Target) -> DataFrame:
    """Weight, token budget and epochs of every source."""
    t = bisect_exponent(sources, target)
    powered = sources.withColumn("raw", F.pow("share", F.lit(t)))
    z, most = powered.agg(F.sum("raw"), F.max(F.col("tokens") / F.col("raw"))).first()
    if not z:
        return powered.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("epochs"), F.lit(t).alias("exponent"))
    budget = float(target.budget) if target.budget is not None else most * z
    weight = F.col("raw") / F.lit(z)
    return powered.select("source", "tokens", weight.alias("weight"), (weight * F.lit(budget) / F.col("tokens")).alias("epochs"), F.lit(t).alias("exponent"))


def mix_documents(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The mixture: rows of `docs`, each as often as its source's budget says, with `epoch`, `mix_weight` and `mix_place` (see `added`).

    `mix_place` in [0, epochs of the source) orders a source's rows; divided by
    the source's epochs it interleaves all sources in proportion to their weights.
    """
    plain = docs.select(docs["source"].cast("string").alias("source"), docs["text"], F.xxhash64(docs["doc_id"], docs["text"]).alias("mix_key"))
    sized = cut(plain.withColumn("mix_tokens", token_count()).groupBy("source", "mix_key").agg(F.sum("mix_tokens").alias("mix_tokens")))
    blocks = max(BLOCKS, math.ceil(sized.count() / BLOCK_ROWS))
    return _realise(docs, sized.withColumn("mix_block", F.pmod(F.col("mix_key"), F.lit(blocks)).cast("int")), target)


def _realise(docs: DataFrame, sized: DataFrame, target: Target) -> DataFrame:
    sources = source_tokens(sized)
    weights = cut(plan(sources, target))
    # blocks in each epoch's own order; the running share of the source's tokens says when the budget is spent
    blocks = sized.groupBy("source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens"))
    epochs = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("epochs") - 1e-9).cast("int") - 1, F.lit(0))))
    visits = blocks.join(weights, F.equal_null(blocks["source"], weights["source"])).drop(weights["source"]).select("source", "mix_block", "block_tokens", "tokens", "weight", "epochs", epochs.alias("epoch"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("mix_block", "epoch", F.lit(5)), "mix_block")
    before = F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    visits = visits.withColumn("start", F.col("epoch") + before / F.col("tokens"))
    visits = visits.where(F.col("start") < F.col("epochs") - 1e-9)
    # a document's place in its block: running tokens over the block's keys
    inside = Window.partitionBy("source", "mix_block").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    places = sized.select("source", "mix_block", "mix_key", "mix_tokens", F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0)).alias("inner"))
    chosen = (
        places.alias("p")
        .join(visits.alias("v"), F.equal_null("p.source", "v.source") & (F.col("p.mix_block") == F.col("v.mix_block")))
        .select("p.mix_key", F.col("p.source").alias("mix_source"), "epoch", F.col("weight").alias("mix_weight"), "epochs", (F.col("start") + F.col("inner") / F.col("tokens")).alias("mix_place"))
        .where(F.col("mix_place") < F.col("epochs") - 1e-9)
        .drop("epochs")
    )
    key, source, of = free(docs.columns, "mix_key", "mix_source", "mix_of")
    epoch, weight, place = added([*docs.columns, key, source, of])
    chosen = chosen.select(F.col("mix_key").alias(of), F.col("mix_source").alias(source), F.col("epoch").alias(epoch), F.col("mix_weight").alias(weight), F.col("mix_place").alias(place))
    keyed = docs.withColumn(key, F.xxhash64(docs["doc_id"], docs["text"]))
    joined = keyed.join(chosen, (F.col(key) == F.col(of)) & F.equal_null(keyed["source"].cast("string"), F.col(source)))
    return joined.select(*docs.columns, epoch, weight, place)
