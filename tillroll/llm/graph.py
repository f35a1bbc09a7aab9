"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import remove, written

#: Edges that one task finishes (16 bytes each); more are contracted first, so the bound holds at every size.
FEW = 1 << 19


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, to) of the ends of all edges (a, b) of a partition: the least node of the end's component."""
    held = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches if batch.num_rows]
    if not held:
        return
    nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    left, right = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["u", "to"])


def components(edges: DataFrame, few: int = FEW) -> tuple[DataFrame, str]:
    """(node, root) for each end of the ``edges`` (a, b), as a table, and its path; equal roots mean one component.

    Contraction: while more than ``few`` edges are left, each node moves to that neighbour (or itself) which comes first
    in a random order of the round, and edges inside one node vanish.  The number of nodes falls by
    a factor in each round, also along chains and stars.  The few edges at the end are joined in one task.
    Edges and moves of every round are written to the shared folder.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest, rest_at = written(both, "edges")
    steps, gone, turn = [], [rest_at], 0
    while rest.count() > few:
        turn += 1
        order = F.xxhash64("v", F.lit(turn))
        pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
        near = rest.select(F.inline(F.array(pair("a", "b"), pair("b", "a"), pair("a", "a"), pair("b", "b"))))
        moves, moves_at = written(near.groupBy("u").agg(F.min_by("v", F.struct(order, "v")).alias("to")), "moves")
        left, right = moves.select(F.col("u").alias("a"), F.col("to").alias("x")), moves.select(F.col("u").alias("b"), F.col("to").alias("y"))
        moved = rest.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        rest, rest_at = written(moved, "edges")
        steps.append(moves)
        gone += [moves_at, rest_at]
    steps.append(rest.repartition(1).mapInArrow(_roots, "u bigint, to bigint"))
    labels = steps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        labels = labels.join(step, labels.root == step.u, "left").select("node", F.coalesce("to", "root").alias("root"))
    labels, labels_at = written(labels, "labels")
    remove(spark, *gone)
    return labels, labels_at
