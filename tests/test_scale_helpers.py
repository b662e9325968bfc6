"""The skew- and size-proof helpers against brute force, with their limits made tiny."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemark.operators import metadata, metrics, ranking
from sievemark.operators.quantiles import exact_quantile
from sievemark.operators.skew import attach_group_values


def skewed(spark, n=600):
    rng = random.Random(1)
    rows = [(f"r{i:04d}", "hot" if i % 3 == 0 else f"k{rng.randrange(150)}", ["train", "val", "test"][i % 3 if i % 7 else 0], i % 2)
            for i in range(n)]
    return spark.createDataFrame(rows, "record_id string, content_hash string, split string, label int")


def brute_flags(rows):
    pdf = rows.toPandas()
    size = pdf.groupby("content_hash")["record_id"].transform("size")
    cross = pdf.groupby("content_hash")["split"].transform("nunique") > 1
    return {r: (int(n), bool(c)) for r, n, c in zip(pdf["record_id"], size, cross)}


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_duplicate_flags_do_not_depend_on_the_hot_limit(spark, hot_rows):
    rows = skewed(spark)
    got = metadata.add_duplicate_flags(rows, hot_rows=hot_rows).collect()
    assert {r["record_id"]: (r["duplicate_count"], r["cross_split_duplicate_flag"]) for r in got} == brute_flags(rows)
    assert len(got) == 600


def test_hot_rows_are_spread_over_the_shuffle(spark):
    rows = skewed(spark)
    groups = metadata.duplicate_groups(rows)
    out = attach_group_values(rows, groups, "content_hash", "duplicate_count", ["duplicate_count"],
                              spread_by=["record_id"], hot_rows=50)
    assert out.where("content_hash = 'hot' and duplicate_count <> 200").count() == 0


def test_null_keys_match_nothing(spark):
    rows = spark.createDataFrame([("a", None), ("b", "x"), ("c", "x")], "record_id string, k string")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = {r["record_id"]: r["n"] for r in attach_group_values(
        rows, groups, "k", "n", ["n"], spread_by=["record_id"]).collect()}
    assert out == {"a": None, "b": 2, "c": 2}


def test_peer_members(spark):
    rows = skewed(spark)
    pdf = rows.toPandas()
    members = pdf.groupby("content_hash")["record_id"].apply(sorted).to_dict()
    long = metadata.duplicate_peers(rows, hot_rows=50).toPandas().groupby("content_hash")["peer_id"].apply(sorted).to_dict()
    assert long == {h: m for h, m in members.items() if len(m) > 1}


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.993, 1.0])
@pytest.mark.parametrize("direct_rows", [5, 10**6])
def test_exact_quantile(spark, q, direct_rows):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 700), np.full(400, 0.25), rng.exponential(50, 50)])
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(4)
    assert exact_quantile(df, "x", q, direct_rows=direct_rows, rank_error=0.01) == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_exact_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None


def test_running_totals(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": ["a"] * 300 + ["b"] * 5, "s": rng.permutation(305).astype(float), "n": rng.integers(0, 9, 305)})
    df = spark.createDataFrame(pdf)
    bounds = ranking.quantile_bounds(df, "s", rows_per_bucket=20)
    assert len(bounds) >= 10 and ranking.quantile_bounds(df, "s") == []
    for descending, cuts in itertools.product((False, True), (None, bounds)):
        out = ranking.running_totals(df, ["g"], "s", ["n"], descending=descending, bounds=cuts).toPandas()
        expected = pdf.sort_values("s", ascending=not descending)
        expected["n_before"] = expected.groupby("g")["n"].cumsum() - expected["n"]
        merged = out.merge(expected, on=["g", "s"], suffixes=("", "_want"))
        assert len(merged) == 305 and (merged["n_before"] == merged["n_before_want"]).all()


def test_range_row_number(spark):
    rows = [(f"p{i:03d}", None if i % 5 == 0 else float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, v double")
    order = [F.col("v").desc_nulls_last(), F.col("path").asc()]
    got = [r["path"] for r in ranking.range_row_number(df, order, "rn", partitions=6).orderBy("rn").collect()]
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == [path for path, _ in wanted]


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_auc_with_ties_one_class_and_missing(spark):
    rng = np.random.default_rng(7)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 40, 400).astype(float)
    rows = [("a", int(a), float(b)) for a, b in zip(y, s)] + [("one", 1, 0.5), ("one", 1, 0.7), ("gap", 1, None), ("gap", 0, 0.1)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    steps = metrics.score_steps(df, ["g"], "label", "score")
    bucketed = {r["g"]: r["auc"] for r in metrics.auc_of_steps(steps, ["g"], bounds=[3.0, 11.0, 30.0]).collect()}
    got = {r["g"]: r["auc"] for r in metrics.auc_rank(df, ["g"]).collect()}
    assert bucketed == pytest.approx(got)
    assert got["a"] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert got["one"] is None and got["gap"] is None


def test_threshold_ties_go_to_the_highest(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)], "label int, score double")
    row = metrics.select_threshold(df).first()
    assert (row["threshold"], row["youden_j"]) == (0.9, 0.5)


def test_plan_has_no_single_partition_sort_of_rows(spark):
    """Rank per label is computed in buckets: the row-level window is partitioned by more than the label."""
    from sievemark.operators.splits import stratified_folds

    rows = spark.range(1000).select(
        (F.col("id") % 2).cast("int").alias("label"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    folds = stratified_folds(rows, 3)
    plan = folds._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    counts = folds.groupBy("label", "fold").count().collect()
    assert len(counts) == 6 and max(c["count"] for c in counts) - min(c["count"] for c in counts) <= 1


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    from conftest import SMALL
    from sievemark.operators import analysis
    from sievemark.plans import given

    plan = plan_of(analysis.class_balance(given.docs(spark, SMALL)))
    assert "text:string" not in plan and "n_chars" not in plan


def test_split_and_length_filters_reach_the_scan(spark, tmp_path):
    from sievemark.session import scratch_path
    from sievemark.sources import files, tables

    path = scratch_path(spark, "samples")
    rows = spark.createDataFrame([("train", 0, 1, [1.0]), ("val", 0, 0, [2.0])],
                                 "split string, split_index bigint, label bigint, vec array<double>")
    rows.write.partitionBy("split").parquet(path)
    assert "PartitionFilters: [isnotnull(split" in plan_of(tables.scan_labeled_samples(spark, path, "val"))
    (tmp_path / "a.bin").write_bytes(b"x")
    plan = plan_of(files.scan_bounded(spark, str(tmp_path)))
    assert "GreaterThan(length,26214400)" in plan and "LessThanOrEqual(length,26214400)" in plan


def test_groups_combine_before_the_shuffle(spark):
    """A hot hash leaves each task as one row: partial aggregate below the exchange."""
    from sievemark.operators import dedup

    rows = dedup.pool_splits(skewed(spark).withColumn("split_index", F.monotonically_increasing_id()))
    plan = plan_of(dedup.dedup_groups(rows))
    assert plan.index("Exchange") < plan.index("partial_min") and "Window" not in plan


def test_required_tables(spark):
    from sievemark.operators import checks

    spark.range(1).createOrReplaceTempView("present_view")
    assert checks.check_tables_exist(spark, ["present_view", "absent_view"]) == ["absent_view"]


def test_missing_labels_are_an_error_not_a_loss(spark):
    from sievemark.operators.splits import stratified_folds

    rows = spark.createDataFrame([("a" * 64, 1), ("b" * 64, None)], "content_hash string, label int")
    with pytest.raises(Exception, match="label must not be NULL"):
        stratified_folds(rows, 2).collect()


def test_quantile_of_mostly_equal_values(spark):
    values = np.concatenate([np.full(900, 2.0), np.linspace(0, 4, 101)])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    for q in (0.01, 0.05, 0.5, 0.96):
        assert exact_quantile(df, "x", q, direct_rows=20, rank_error=0.01) == pytest.approx(np.quantile(values, q))


def test_groups_beyond_the_broadcast_join_unsalted(spark, monkeypatch):
    from sievemark.operators import skew

    rows = skewed(spark)
    groups = metadata.duplicate_groups(rows)
    for most in (0, 1, 100_000):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
        out = attach_group_values(rows, groups, "content_hash", "duplicate_count", ["duplicate_count"],
                                  spread_by=["record_id"], hot_rows=2)
        assert out.count() == rows.count()
        assert out.where("content_hash = 'hot' and duplicate_count <> 200").count() == 0


def test_sparse_indexes_do_not_make_a_bucket_each(spark, monkeypatch):
    values = [k * 10**12 + k * k for k in range(400)]
    df = spark.createDataFrame([("a" if k % 3 else "b", v) for k, v in enumerate(values)], "g string, i bigint")
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 50)
    monkeypatch.setattr(ranking.quantile_bounds, "__defaults__", (50,))
    got = ranking.index_rank(df, ["g"], F.lit(0), "i").toPandas()
    assert set(got.columns) == {"g", "i", "rank"}
    for _, part in got.groupby("g"):
        part = part.sort_values("i")
        assert part["rank"].tolist() == list(range(1, len(part) + 1))


def test_duplicate_facts_hash_and_do_not_sort(spark):
    from sievemark.operators import dedup, splits

    rows = skewed(spark)
    pooled = dedup.pool_splits(rows.withColumn("split_index", F.monotonically_increasing_id()))
    for df in (dedup.dedup_groups(pooled), metadata.hash_groups(rows), splits.repeated_hashes(rows.withColumnRenamed("split", "assigned_split"))):
        assert "SortAggregate" not in plan_of(df)


def test_records_of_unknown_splits_are_an_error(spark):
    from sievemark.operators import dedup

    rows = spark.createDataFrame([("other", 0, 1, "h")], "split string, split_index bigint, label int, content_hash string")
    with pytest.raises(Exception, match="unknown split other"):
        dedup.deduplicate(dedup.pool_splits(rows)).collect()


def test_a_run_can_be_dropped(spark):
    from unittest.mock import patch

    from sievemark import session

    folder = session.scratch_path(spark, "own-run")  # stands for the run folder, so that other tests keep theirs
    with patch.object(session, "run_folder", lambda _: folder):
        assert session.materialize(spark.range(3)).count() == 3
        assert session.drop_run(spark) and not session.drop_run(spark)
