"""Digest tree of the hashes in each split: equal sets have equal roots, and a difference is found by walking down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.session import materialize

STEP = 2              # hex digits from one level to the next: a node has at most 256 children
LEAF_ROWS = 4_096     # hashes a leaf should hold at most, on average
MAX_DEPTH = 12


def leaf_depth(hashes: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Hex digits of a leaf's prefix, so that leaves of evenly spread hashes hold at most about ``leaf_rows``."""
    depth = STEP
    while depth < MAX_DEPTH and hashes > leaf_rows * 16**depth:
        depth += STEP
    return depth


def digest_tree(assigned: DataFrame, depth: int | None = None, split: str = "assigned_split", key: str = "content_hash") -> DataFrame:
    """(split, depth, prefix, digest, hashes) of every node; the root of a split has the empty prefix.

    A leaf digests its hashes in order, each as often as it occurs; a node
    above digests its children's prefixes and digests in order. No task
    gathers more than a leaf's hashes or 256 children, and equal hashes are
    counted before they meet. NULL hashes are an error. Trees to be compared need the same ``depth``.
    """
    if depth is None:
        depth = leaf_depth(assigned.count())
    if depth % STEP:
        raise ValueError(f"the depth is a multiple of {STEP}")
    known = F.coalesce(F.col(key), F.raise_error(F.lit("a hash is NULL")).cast("string"))
    counted = assigned.groupBy(F.col(split).alias("split"), known.alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.col("hash"), F.when(F.col("n") > 1, F.concat(F.lit("*"), F.col("n").cast("string"))).otherwise(""))
    leaves = counted.groupBy("split", F.substring("hash", 1, depth).alias("prefix")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.sum("n").alias("hashes")
    )
    tree = level = materialize(leaves.withColumn("depth", F.lit(depth)), "leaves")
    for d in range(depth - STEP, -1, -STEP):
        child = F.concat_ws(":", "prefix", "digest")
        above = level.groupBy("split", F.substring("prefix", 1, d).alias("prefix")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("digest"), F.sum("hashes").alias("hashes")
        )
        level = materialize(above.withColumn("depth", F.lit(d)), "nodes")
        tree = tree.unionByName(level)
    return tree.select("split", "depth", "prefix", "digest", "hashes")


def roots(tree: DataFrame) -> DataFrame:
    """(split, digest, hashes): one row a split."""
    return tree.where("depth = 0").select("split", "digest", "hashes")


def tree_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(split, prefix) of the leaves that differ, walking from the roots down into differing nodes only.

    ``left`` and ``right`` are written trees of one depth; a level reads the children of the nodes found above.
    """
    depths = [sorted(r["depth"] for r in t.select("depth").distinct().collect()) for t in (left, right)]     # at most seven numbers
    if depths[0] and depths[1] and depths[0] != depths[1]:
        raise ValueError("trees of different depth")
    levels = depths[0] or depths[1] or [0]
    found = None
    for d in levels:
        parts = []
        for side, tree in (("l", left), ("r", right)):
            nodes = tree.where(F.col("depth") == d).select("split", "prefix", "digest")
            if found is not None:
                above = found.select(F.col("split").alias("s"), F.col("prefix").alias("p"))
                nodes = nodes.join(above, (nodes["split"] == above["s"]) & (F.substring(nodes["prefix"], 1, d - STEP) == above["p"]), "left_semi")
            parts.append(nodes.withColumnRenamed("digest", side))
        both = parts[0].join(parts[1], ["split", "prefix"], "full")
        found = materialize(both.where(~F.col("l").eqNullSafe(F.col("r"))).select("split", "prefix"), "differing")
    return found


def write_by_prefix(assigned: DataFrame, path: str, key: str = "content_hash") -> DataFrame:
    """The manifest in folders by the first two digits of the hash, so that a difference reads only the folders it needs."""
    placed = assigned.withColumn("part", F.substring(key, 1, STEP))
    placed.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(path)
    return assigned.sparkSession.read.schema(placed.schema).parquet(path)


def changed_hashes(left: DataFrame, right: DataFrame, leaves: DataFrame, split: str = "assigned_split", key: str = "content_hash") -> DataFrame:
    """(split, hash, left, right): how often each hash stands on either side, where that differs.

    ``left`` and ``right`` come from ``write_by_prefix``; only the folders and
    prefixes of ``leaves``, as ``tree_difference`` gives them, are read.
    """
    parts = [r[0] for r in leaves.select(F.substring("prefix", 1, STEP)).distinct().collect()]     # at most 256
    lengths = [r[0] for r in leaves.select(F.length("prefix")).distinct().collect()] or [STEP]
    wanted = leaves.select(F.col("split").alias("s"), F.col("prefix").alias("p"))
    sides = []
    for name, rows in (("left", left), ("right", right)):
        some = rows.where(F.col("part").isin(parts)).select(F.col(split).alias("split"), F.col(key).alias("hash"))
        some = some.join(wanted, (some["split"] == wanted["s"]) & (F.substring(some["hash"], 1, lengths[0]) == wanted["p"]), "left_semi")
        sides.append(some.groupBy("split", "hash").agg(F.count(F.lit(1)).alias(name)))
    both = sides[0].join(sides[1], ["split", "hash"], "full").na.fill(0, ["left", "right"])
    return both.where("left <> right")
