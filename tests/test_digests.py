"""Digest trees, sketches and rules counted while writing."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sievemark.operators import checks, digests, sketches
from sievemark.session import materialize, scratch_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def manifest(spark):
    rows = [(("train", "val", "test")[k % 3], sha(str(k))) for k in range(900)] + [("train", sha("0"))] * 3
    return materialize(spark.createDataFrame(rows, "assigned_split string, content_hash string"))


def plain_root(hashes, depth):
    counted = {h: hashes.count(h) for h in set(hashes)}
    level = {}
    for h, n in counted.items():
        level.setdefault(h[:depth], []).append(h if n == 1 else f"{h}*{n}")
    level = {p: sha("\n".join(sorted(x))) for p, x in level.items()}
    for d in range(depth - 2, -1, -2):
        above = {}
        for p, digest in level.items():
            above.setdefault(p[:d], []).append(f"{p}:{digest}")
        level = {p: sha("\n".join(sorted(x))) for p, x in above.items()}
    return level[""]


@pytest.mark.parametrize("depth", [2, 4, 6])
def test_roots_by_hand(manifest, depth):
    got = {r["split"]: (r["digest"], r["hashes"]) for r in digests.roots(digests.digest_tree(manifest.repartition(7), depth)).collect()}
    rows = manifest.collect()
    for split in ("train", "val", "test"):
        own = [r["content_hash"] for r in rows if r["assigned_split"] == split]
        assert got[split] == (plain_root(own, depth), len(own))


def test_moving_one_hash_changes_one_leaf_a_split(spark, manifest):
    moved = sha("7")
    other = manifest.withColumn("assigned_split", F.when(F.col("content_hash") == moved, "test").otherwise(F.col("assigned_split")))
    paths = [scratch_path(spark, "m") for _ in range(2)]
    left, right = (digests.write_by_prefix(m, p) for m, p in zip((manifest, other), paths, strict=True))
    trees = [digests.digest_tree(m, 4) for m in (left, right)]
    both = trees[0].join(trees[1].withColumnRenamed("digest", "r"), ["split", "depth", "prefix"], "full").where("not digest <=> r")
    assert {(r["split"], r["prefix"]) for r in both.collect()} == {(s, moved[:k]) for s in ("val", "test") for k in (0, 2, 4)}
    leaves = digests.tree_difference(*trees)
    assert {tuple(r) for r in leaves.collect()} == {("val", moved[:4]), ("test", moved[:4])}
    changed = digests.changed_hashes(left, right, leaves)
    assert {tuple(r) for r in changed.collect()} == {("val", moved, 1, 0), ("test", moved, 0, 1)}
    # The scans of both manifests are pruned to the folder of the hash's first two digits.
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"PartitionFilters: \[[^\]]*= {moved[:2]}\)", plan)) >= 2


def test_equal_and_empty_trees(spark, manifest):
    tree = digests.digest_tree(manifest, 4)
    assert digests.tree_difference(tree, digests.digest_tree(manifest.repartition(3), 4)).count() == 0
    none = digests.digest_tree(manifest.limit(0), 4)
    assert none.count() == 0 and digests.tree_difference(none, none).count() == 0
    assert digests.tree_difference(tree, none).count() == tree.where("depth = 4").count()
    with pytest.raises(ValueError):
        digests.tree_difference(tree, digests.digest_tree(manifest, 2))
    with pytest.raises(ValueError):
        digests.digest_tree(manifest, 3)
    with pytest.raises(Exception, match="a hash is NULL"):
        digests.digest_tree(manifest.withColumn("content_hash", F.lit(None).cast("string")), 2)
    assert [digests.leaf_depth(n) for n in (0, 10**6, 10**7, 10**9, 10**14)] == [2, 2, 4, 6, 10]


def test_quantile_sketches_merge(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(50_000)]
    rows = materialize(spark.createDataFrame([(k % 7, v) for k, v in enumerate(values)] + [(1, None), (2, float("nan"))], "part int, v double"))
    stored = materialize(sketches.quantile_sketches(rows, "v", ["part"]))
    row = sketches.merged_quantiles(stored, [0.01, 0.5, 0.99]).first()
    assert row["n"] == 50_000 and stored.count() == 7
    ordered = sorted(values)
    for p, q in zip((0.01, 0.5, 0.99), row["quantiles"], strict=True):
        below = sum(v < q for v in ordered) / len(ordered)
        assert abs(below - p) <= sketches.RANK_ERROR
    again = sketches.low_variance_bound(stored).first()["threshold"]     # merging draws at random
    assert abs(sum(v < again for v in ordered) / len(ordered) - 0.01) <= sketches.RANK_ERROR
    assert sketches.merged_quantiles(sketches.quantile_sketches(rows.limit(0), "v"), [0.5]).count() == 0


def test_id_sketches(spark):
    rows = materialize(spark.range(60_000).select(
        (F.col("id") % 40_000).cast("string").alias("key"), F.when(F.col("id") % 40_000 < 30_000, "a").when(F.col("id") % 40_000 < 35_000, "b").alias("f"),
        (F.col("id") % 40_000 % 4).cast("string").alias("g")))
    parts = [sketches.id_sketches(rows.where(f"pmod(hash(key), 3) = {k}"), "key", ["f", "g"]) for k in range(3)]
    merged = materialize(sketches.merged_ids(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    about = lambda filters=None: sketches.distinct_ids(merged, filters).first()["ids"]
    assert about({"f": ["b"]}) == 5_000 and about({"f": [None]}) == 5_000
    for filters, exact in (({}, 40_000), ({"f": ["a"]}, 30_000), ({"f": ["a", "b"]}, 35_000), ({"f": ["a"], "g": ["1", "2"]}, 15_000)):
        assert abs(about(filters) - exact) <= sketches.COUNT_ERROR * 40_000
    assert about({"f": ["unknown"]}) == 0 and about({"f": ["a"], "g": ["9"]}) == 0


def test_rules_are_counted_by_the_write(spark):
    rows = spark.createDataFrame(
        [(f"r{k}", "train" if k != 3 else "other", k - 1, k % 2, 8, 8, 0.5, -1.0 if k < 3 else 1.0, 0.0, float("nan") if k == 4 else 1.0, "0" * 64)
         for k in range(10)],
        "record_id string, split string, split_index long, label int, width long, height long, mean_value double, std_value double, min_value double,"
        " max_value double, content_hash string")
    path = scratch_path(spark, "checked")
    counted = checks.write_checked(rows, path)
    assert {n: c for n, c in counted.items() if c} == {"split": 1, "split_index": 1, "std_value": 3, "max_value": 1}
    stored = spark.read.parquet(path)
    listed = {r["record_id"]: r["broken_rules"] for r in checks.broken_rows(stored, counted).collect()}
    single = {r["record_id"]: r["broken_rules"].split(",") for r in checks.check_row_schema(stored).collect()}
    assert listed == single and stored.count() == 10
    assert checks.write_checked(rows.limit(0), scratch_path(spark, "checked")) == dict.fromkeys(checks.row_rules(), 0)
    fine = checks.broken_rows(stored, dict.fromkeys(counted, 0))
    assert fine.count() == 0 and "FileScan" not in fine._jdf.queryExecution().optimizedPlan().toString()
    only = checks.write_checked(rows, scratch_path(spark, "checked"), {"small": F.col("split_index") < 5, "known": F.col("label").isNotNull()})
    assert only == {"small": 4, "known": 0}
