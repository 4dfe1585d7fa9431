"""Connected components of a graph of document ids, by contraction to least neighbours.

Defined results: an edge from a node to itself says nothing; an empty table of
edges gives no rows; repeated edges count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.store import cut

#: Edges that a task takes together; parts that the rows of one key are looked up in; rounds until labels are written.
HELD, PARTS, LAZY = 1 << 21, 64, 4


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node that each is connected to; for edges inside one task."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)  # the trees' roots, too
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def looked_up(rows: DataFrame, key: str, table: DataFrame, spread_by: str, how: str = "inner") -> DataFrame:
    """`rows` with the columns that `table` (one row for each `key`) has for them.

    A key may hold any share of the rows: its rows are dealt to PARTS parts by
    `spread_by`, each part asks once, and the answer meets the part's rows only.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(spread_by), F.lit(PARTS)).cast("int"))
    answers = dealt.select(key, "part").distinct().join(table, key)
    return dealt.join(answers, [key, "part"], how).drop("part")


def contracted(edges: DataFrame) -> DataFrame:
    """As few edges (a, b) as a task can say the same connections with; edges meet by `a`, in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= HELD:
                yield _forest_rows(held)
                held, size = [], 0
        if size:
            yield _forest_rows(held)

    return edges.select("a", "b").repartition("a").mapInArrow(run, "a bigint, b bigint")


def _forest_rows(held: list) -> pa.RecordBatch:
    node, root = forest(*(np.concatenate(x) for x in zip(*held)))
    moved = node != root
    return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(root[moved])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b) with another one: the least node reachable from it.

    In each round every node takes the least node near it as its parent (and
    that one's parent), and edges go on between parents, so the graph shrinks
    by at least half; edges and parents are written between rounds, labels when
    LAZY rounds have moved them.  Rows look their parents up in plain joins, in
    which Spark itself divides the rows of a frequent node; only parents look
    up their own parents by parts, since they already lie by node.
    """
    left, labels, rounds = cut(contracted(edges)), None, 0
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p"))
        above = near.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = cut(looked_up(near, "p", above, "node").select("node", F.least("p", "pp").alias("p")))
        rounds += 1
        if labels is None:
            labels = parent.withColumnRenamed("p", "label")
        else:
            moved = parent.select(F.col("node").alias("label"), "p")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
            if rounds % LAZY == 0:
                labels = cut(labels)
        a, b = (parent.select(F.col("node").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        moved = left.join(a, "a").join(b, "b")
        left = cut(_plain(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _plain(edges: DataFrame) -> DataFrame:
    """Each edge once, none from a node to itself."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
