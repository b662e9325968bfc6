"""Connected components by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); nodes of a component share their root.

    In each round a node moves to the first of itself and its neighbours and
    edges are redrawn between the places moved to, so hubs disappear at once
    (by node order in even rounds) and paths shrink by a constant share (by a
    hash that differs in odd rounds). The rounds are logarithmic in the longest
    path, and the stored maps together are about twice the nodes. Edges of a hub are
    combined before the shuffle and joined by a sort-merge join that Spark can split.
    """
    left = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        order = F.col("to") if len(moves) % 2 == 0 else F.xxhash64("to", F.lit(len(moves)))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        nearest = both.groupBy("node").agg(F.min_by("to", order).alias("to"), F.min(order).alias("first"))
        own = F.col("node") if len(moves) % 2 == 0 else F.xxhash64("node", F.lit(len(moves)))
        move = materialize(nearest.select("node", F.when(F.col("first") < own, F.col("to")).otherwise(F.col("node")).alias("to")), "moves")
        moves.append(move)
        moved = (
            left.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        )
        left = materialize(
            moved.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges"
        )
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    place = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        further = move.select(F.col("node").alias("root"), F.col("to").alias("next"))
        place = place.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialize(place, "components")


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` indexes reaches over the pairs (i, j)."""
    roots = np.arange(n)
    while i.size:
        low = np.minimum(roots[i], roots[j])
        before = roots.copy()
        np.minimum.at(roots, i, low)
        np.minimum.at(roots, j, low)
        roots = roots[roots]
        if np.array_equal(before, roots):
            break
    return roots
