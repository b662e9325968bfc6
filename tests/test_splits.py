"""Planted duplicates: pooling, deduplication and splits."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.functions.raster import affine
from sievemark.operators import dedup, splits


def record(seed):
    return np.random.default_rng(seed).integers(0, 256, 784).astype(np.uint8).tobytes()


@pytest.fixture(scope="module")
def pooled(spark):
    """60 unique records, plus: 0 in val and test, 1 twice in train, 2 in test with the other label."""
    source = ["train"] * 40 + ["val"] * 10 + ["test"] * 10
    rows = [(record(i), i % 2, s) for i, s in enumerate(source)]
    rows += [(record(0), 0, "val"), (record(0), 0, "test"), (record(1), 1, "train"), (record(1), 1, "train"),
             (record(2), 1, "test")]
    seen = {}
    data = []
    for payload, label, split in rows:
        seen[split] = seen.get(split, -1) + 1
        data.append((split, seen[split], label, hashlib.sha256(payload).hexdigest()))
    df = spark.createDataFrame(data, "split string, split_index bigint, label int, content_hash string")
    return dedup.pool_splits(df).cache()


def test_report(pooled):
    row = dedup.dedup_report(pooled, "drop").first().asDict()
    assert row == {
        "input_records": 65, "unique_records": 60, "duplicate_groups": 3, "redundant_copies_removed": 5,
        "label_conflict_groups": 1, "label_conflict_policy": "drop", "label_conflict_records_dropped": 1,
        "retained_records": 59,
    }
    kept = dedup.dedup_report(pooled, "keep_first").first()
    assert (kept["retained_records"], kept["label_conflict_records_dropped"]) == (60, 0)


def test_no_hash_repeats_and_first_copy_is_kept(pooled):
    out = splits.build_splits(pooled).cache()
    assert out.count() == 59
    assert splits.repeated_hashes(out).count() == 0
    zero = hashlib.sha256(record(0)).hexdigest()
    row = out.where(F.col("content_hash") == zero).first()
    assert (row["source_split"], row["source_index"]) == ("train", 0)
    conflict = hashlib.sha256(record(2)).hexdigest()
    assert out.where(F.col("content_hash") == conflict).count() == 0


def test_sizes_follow_the_ceiling_rule(pooled):
    # 65 records, 11 in val and 12 in test before deduplication; 59 retained.
    test = int(np.ceil(12 / 65 * 59))
    val = int(np.ceil((11 / 65) / (1 - 12 / 65) * (59 - test)))
    sizes = {r["assigned_split"]: r["size"] for r in splits.split_sizes(splits.build_splits(pooled)).collect()}
    assert sizes == {"train": 59 - test - val, "val": val, "test": test}


def test_labels_are_shared_evenly(pooled):
    rows = splits.build_splits(pooled).groupBy("assigned_split").agg(F.avg("label").alias("share")).collect()
    assert all(abs(r["share"] - 0.5) < 0.1 for r in rows)


def test_same_seed_same_split_other_seed_other_split(pooled):
    def fingerprint(seed):
        return splits.split_fingerprint(splits.build_splits(pooled.repartition(3), seed=seed)).first()[0]

    assert fingerprint(42) == fingerprint(42) != fingerprint(43)


def test_manifest_positions(pooled):
    manifest = splits.split_manifest(splits.build_splits(pooled)).toPandas()
    rank = {"train": 0, "val": 1, "test": 2}
    for _, part in manifest.groupby("assigned_split"):
        part = part.sort_values("assigned_index")
        assert part["assigned_index"].tolist() == list(range(len(part)))
        order = list(zip(part["source_split"].map(rank), part["source_index"]))
        assert order == sorted(order)


def test_official_split(pooled):
    out = splits.build_splits(pooled, deduplicate_records=False)
    sizes = {r["assigned_split"]: r["size"] for r in splits.split_sizes(out).collect()}
    assert sizes == {"train": 42, "val": 11, "test": 12}


def test_all_conflicting_gives_empty_splits(spark):
    h = "a" * 64
    data = [(s, i, i, h) for s in ("train", "val", "test") for i in (0, 1)]
    df = spark.createDataFrame(data, "split string, split_index bigint, label int, content_hash string")
    assert splits.build_splits(dedup.pool_splits(df)).count() == 0


def test_bad_arguments(pooled):
    with pytest.raises(ValueError):
        dedup.deduplicate(pooled, "unknown")
    for val, test in ((0.0, 0.1), (0.1, 1.0), (0.5, 0.5)):
        with pytest.raises(ValueError):
            splits.resolve_fractions(pooled, preserve=False, val_fraction=val, test_fraction=test)
    with pytest.raises(ValueError):
        splits.augment_training(pooled, copies=0)


def test_augmentation_keeps_originals_and_bounds(spark):
    rows = spark.createDataFrame([(i, i % 2, [0.0, 100.0, 255.0], f"{i:064d}") for i in range(40)],
                                 "vec_id int, label int, vec array<double>, content_hash string")
    out = splits.augment_training(rows, copies=2).toPandas()
    assert len(out) == 120
    assert all(list(v) == [0.0, 100.0, 255.0] for v in out[out["copy"] == 0]["vec"])
    changed = [list(v) for v in out[out["copy"] > 0]["vec"]]
    assert all(0.0 <= x <= 255.0 for v in changed for x in v)
    share = np.mean([v != [0.0, 100.0, 255.0] for v in changed])
    assert 0.2 < share < 0.8


def warped_by_hand(vec, width, sx, sy, tx, ty, degrees):
    height, turn = len(vec) // width, math.radians(degrees)

    def cell(c, r):
        return vec[r * width + c] if 0 <= c < width and 0 <= r < height else 0.0

    out = []
    for place in range(len(vec)):
        x, y = place % width - (width - 1) / 2 - tx, place // width - (height - 1) / 2 - ty
        ox = (x * math.cos(turn) + y * math.sin(turn)) / sx + (width - 1) / 2
        oy = (y * math.cos(turn) - x * math.sin(turn)) / sy + (height - 1) / 2
        c, r = math.floor(ox), math.floor(oy)
        out.append(sum(
            cell(c + i, r + j) * (ox - c if i else 1 - ox + c) * (oy - r if j else 1 - oy + r) for i in (0, 1) for j in (0, 1)))
    return out


@pytest.mark.parametrize("width, size, change", [
    (8, 64, (1.0, 1.0, 0.0, 0.0, 0.0)), (8, 64, (1.1, 0.9, 0.4, -0.3, 7.0)), (5, 15, (0.5, 2.0, 1.0, 0.0, 90.0)), (1, 1, (1.0, 1.0, 0.0, 0.0, 45.0)),
    (4, 16, (1.0, 1.0, 2.0, -1.0, 0.0)), (6, 36, (1.0, 1.0, 0.0, 0.0, 180.0)),
])
def test_affine_warp(spark, width, size, change):
    rng = np.random.default_rng(size)
    vec = rng.uniform(0, 255, size).tolist()
    rows = spark.createDataFrame([(vec, width, *change), (None, width, *change), ([], width, *change)], "vec array<double>, w int, a double, b double, c double, d double, e double")
    got = rows.select(affine(*map(F.col, ("vec", "w", "a", "b", "c", "d", "e"))).alias("v")).collect()
    assert list(got[0]["v"]) == pytest.approx(warped_by_hand(vec, width, *change), abs=1e-9)
    if change == (1.0, 1.0, 0.0, 0.0, 0.0):
        assert list(got[0]["v"]) == vec
    assert got[1]["v"] is None and list(got[2]["v"]) == []


def test_warped_copies(spark):
    vec = [float(k * 3 % 256) for k in range(784)]
    rows = spark.createDataFrame([(i, i % 2, vec, f"{i:064d}") for i in range(60)], "vec_id int, label int, vec array<double>, content_hash string")
    out = splits.augment_training(rows, brightness=0.0, contrast=0.0, probability=1.0).where("copy = 1").toPandas()
    assert all(len(v) == 784 and list(v) != vec for v in out["vec"]) and len({tuple(v) for v in out["vec"]}) == 60
    assert abs(np.mean([np.mean(v) for v in out["vec"]]) - np.mean(vec)) < 10
    still = splits.augment_training(rows, scale=0.0, translate=0.0, rotate=0.0, brightness=0.0, contrast=0.0, probability=1.0)
    assert all(list(r["vec"]) == pytest.approx(vec, abs=1e-9) for r in still.collect())
    wide = rows.withColumn("vec", F.slice("vec", 1, 6))
    changed = splits.augment_training(wide, width=3, brightness=0.0, contrast=0.0, probability=1.0).where("copy = 1").toPandas()
    assert all(len(v) == 6 and list(v) != vec[:6] for v in changed["vec"])
