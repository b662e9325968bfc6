"""Identities, labels, checks and the metadata table."""

import hashlib
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.functions import identity, labels, vectors
from sievemark.operators import analysis, checks, metadata, predictions
from sievemark.plans import flows
from sievemark.session import scratch_path
from sievemark.sources import sinks, tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_hashes_equal_the_standard_library(spark):
    payload = bytes(range(256)) * 3 + bytes(16)
    got = one(spark, h=identity.content_hash("uint8", "(28, 28)", F.lit(payload)), d=identity.file_digest(F.lit(payload)))
    assert got["h"] == hashlib.sha256(b"uint8" + b"(28, 28)" + payload).hexdigest()
    assert got["d"] == hashlib.sha256(payload).hexdigest()


def test_uuid_equals_the_standard_library(spark):
    ns = identity.dataset_namespace("some data set")
    got = one(spark, u=identity.record_uuid(ns, F.lit("train"), F.lit(7), F.lit("ab" * 32)))
    assert got["u"] == str(uuid.uuid5(ns, "train:7:" + "ab" * 32))


@pytest.mark.parametrize("name, expected", [
    ("a.PNG", ".png"), ("nested.name.jpg", ".jpg"), ("none", ""), (".png", ""), ("x.", ""),
])
def test_extension(spark, name, expected):
    assert one(spark, e=labels.file_extension(F.lit(name)))["e"] == expected


def test_numeric_labels(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (float("nan"),), (None,), (3.0,)], "label double")
    got = [r[0] for r in rows.select(labels.normalize_label(F.col("label"))).collect()]
    assert got == ["pneumonia", "normal", None, None, "3.0"]


def test_margin_scaling_never_changes_a_decision(spark):
    rng = np.random.default_rng(0)
    raw = rng.normal(0, 3, 200)
    threshold = float(raw[17])  # ties with a row on purpose
    df = spark.createDataFrame([(float(v),) for v in raw], "raw double")
    out = labels.score_and_decide(F.col("raw"), F.lit(threshold), "margin")
    rows = df.select("raw", out["predicted_class"].alias("c"), out["positive_score"].alias("s"), out["confidence"].alias("f")).collect()
    assert all((r["c"] == "pneumonia") == (r["raw"] >= threshold) for r in rows)
    assert all(0 <= r["s"] <= 1 for r in rows)
    with pytest.raises(ValueError):
        labels.score_and_decide(F.col("raw"), F.lit(0.0), "odds")


@pytest.fixture(scope="module")
def samples(spark):
    """Twelve 2x2 vectors in three splits with a duplicate across splits and one label conflict."""
    vecs = [[float(i), float(i * i % 7), 3.0, float(i % 2)] for i in range(9)]
    data = []
    for i, vec in enumerate(vecs + [vecs[0], vecs[1], vecs[1]]):
        split = ("train", "train", "val", "test")[i % 4]
        label = i % 2 if i < 11 else 0
        data.append((split, label, vec))
    seen, rows = {}, []
    for split, label, vec in data:
        seen[split] = seen.get(split, -1) + 1
        rows.append((split, seen[split], label, vec, hashlib.sha256(repr(vec).encode()).hexdigest()))
    return spark.createDataFrame(rows, "split string, split_index bigint, label int, vec array<double>, content_hash string")


def test_metadata_table_flow(spark, samples):
    ns = identity.dataset_namespace("x")
    path = scratch_path(spark, "metadata")
    stored = flows.build_metadata(samples, path, 2, 2, ns)
    pdf = stored.toPandas()
    assert len(pdf) == 12
    vec = {(r["split"], r["split_index"]): np.array(r["vec"]) for r in samples.collect()}
    for r in pdf.itertuples():
        v = vec[(r.split, r.split_index)]
        assert r.mean_value == pytest.approx(v.mean()) and r.std_value == pytest.approx(v.std())
        assert (r.min_value, r.max_value) == (v.min(), v.max())
    threshold = np.quantile(pdf["std_value"], 0.01)
    assert ((pdf["std_value"] <= threshold + 1e-12) == pdf["low_variance_flag"]).all()
    reports = flows.run_analysis(stored, scratch_path(spark, "reports"))
    assert len(reports) == 7
    summary = reports["qc_summary"].first()
    assert summary["duplicate_groups"] == 2 and summary["duplicate_records"] == 5
    # An existing table is reused; the flow does not touch its input again.
    assert flows.build_metadata(samples.limit(0), path, 2, 2, ns).count() == 12
    assert flows.build_metadata(samples.limit(5), path, 2, 2, ns, force=True).count() == 5


def test_bad_vectors_raise(spark, samples):
    bad = samples.withColumn("vec", F.lit([1.0, float("nan"), 0.0, 0.0]))
    for df, size in ((bad, 2), (samples, 3)):
        with pytest.raises(Exception, match="wrong size or a non-finite"):
            metadata.extract_metadata(df, size, size, identity.dataset_namespace("x")).collect()


def test_conflict_groups_are_written_as_runs(spark):
    rows = spark.createDataFrame(
        [("h", i % 2, "val" if i == 8 else "train") for i in range(9)] + [("u", 1, "train"), ("u", None, "test")],
        "content_hash string, label int, split string")
    only = analysis.duplicate_label_conflicts(rows).collect()
    assert [(r["labels"], r["splits"], r["record_count"]) for r in only] == [("0 x5, 1 x4", "train x8, val x1", 9)]


def test_peer_checks_find_every_defect(spark):
    rows = spark.createDataFrame(
        [("A", "a", 1), ("B", "b", 2), ("B", "b2", 2), ("C", "c", 2), ("C", "c2", 2), ("D", "d", 1), ("E", "e", 2), ("E", "e2", 2)],
        "content_hash string, record_id string, duplicate_count bigint")
    peers = spark.createDataFrame(
        [("A", "a"), ("B", "b"), ("B", "x"), ("C", "c"), ("C", "c"), ("C", "c2"), ("E", "e"), ("E", "e2")],
        "content_hash string, peer_id string")
    found = sorted((r["content_hash"], r["record_id"] or "", r["problem"]) for r in checks.check_peer_ids(rows, peers).collect())
    assert found == [("A", "a", "peers without duplicates"), ("B", "b2", "own id missing"), ("B", "x", "not a record of the group"),
                     ("C", "", "wrong number of peers"), ("C", "c", "repeated peer")]


def test_row_schema_check(spark):
    good = ("r1", "train", 0, 1, 2, 2, 0.5, 0.1, 0.0, 1.0, "a" * 64)
    bad = ("r2", "other", -1, 2, 0, 2, float("nan"), -1.0, 0.0, None, "A" * 64)
    schema = ("record_id string, split string, split_index int, label int, width int, height int, mean_value double,"
              " std_value double, min_value double, max_value double, content_hash string")
    rows = checks.check_row_schema(spark.createDataFrame([good, bad], schema)).collect()
    assert [(r["record_id"], r["broken_rules"]) for r in rows] == [
        ("r2", "split,split_index,label,width,mean_value,std_value,max_value,content_hash")]


def test_missing_and_nonfinite(spark):
    df = spark.createDataFrame([(1, 1.0), (None, float("inf")), (3, None)], "a int, b double")
    got = {r["column_name"]: (r["missing"], r["nonfinite"]) for r in checks.check_missing_nonfinite(df).collect()}
    assert got == {"a": (1, 0), "b": (1, 1)}
    with pytest.raises(checks.CheckFailed):
        checks.require(checks.check_missing_nonfinite(df), "bad")


def test_prediction_inputs_are_validated(spark):
    manifest = spark.createDataFrame([("train", 0, 1, "h0", "test"), ("train", 1, 0, "h1", "test")],
                                     "source_split string, source_index int, label int, content_hash string, assigned_split string")
    schema = "split string, split_index int, record_id string, label int, content_hash string"
    good = [("train", 0, "r0", 1, "h0"), ("train", 1, "r1", 0, "h1")]
    assert predictions.validated_manifest(manifest, spark.createDataFrame(good, schema)).count() == 2
    for rows in (good[:1], good + good[:1], [good[0], ("train", 1, "r1", 0, "other")], [good[0], ("train", 1, "r1", 1, "h1")]):
        with pytest.raises(checks.CheckFailed):
            predictions.validated_manifest(manifest, spark.createDataFrame(rows, schema))


def test_model_names():
    assert predictions.parse_model_list("all") == ["logistic", "svm", "xgboost"]
    assert predictions.parse_model_list(" SVM, logistic,svm,") == ["svm", "logistic"]
    for bad in ("", "other", ","):
        with pytest.raises(ValueError):
            predictions.parse_model_list(bad)


def test_active_model(spark):
    manifest = spark.createDataFrame([("svm",)], "selected_model string")
    assert predictions.resolve_active_model(None, None) == "logistic"
    assert predictions.resolve_active_model(manifest, None, "best") == "svm"
    assert predictions.resolve_active_model(manifest, "XGBoost", "best") == "xgboost"
    with pytest.raises(FileNotFoundError):
        predictions.resolve_active_model(None, "best")
    with pytest.raises(ValueError):
        predictions.resolve_active_model(None, "forest")


def test_metric_policies(spark):
    df = spark.createDataFrame(
        [("a", "r1", 1, 0.9), ("a", "r2", 2, 0.3), ("b", "r1", 1, 0.7), ("b", "r2", 2, None)],
        "model string, run_id string, logged_at int, threshold double")
    half = {r["model"]: r["threshold"] for r in tables.model_metric(df, "threshold", "half").collect()}
    assert half == {"a": 0.3, "b": 0.5}
    first = {r["model"]: r["threshold"] for r in tables.model_metric(df, "threshold", run_id="r1").collect()}
    assert first == {"a": 0.9, "b": 0.7}
    assert tables.model_metric(df, "absent", "null").where("absent is not null").count() == 0
    with pytest.raises(Exception, match="no threshold for model b"):
        tables.model_metric(df, "threshold").collect()
    with pytest.raises(ValueError, match="run_id"):
        sinks.sink_model_metrics(df.drop("run_id"), df, scratch_path(spark, "m"))


def test_lookup(spark, samples):
    assert tables.get_sample(samples, "val", 0)["split"] == "val"
    for split, index, error in (("val", 99, IndexError), ("val", -1, IndexError), ("other", 0, ValueError)):
        with pytest.raises(error):
            tables.get_sample(samples, split, index)


def test_ordered_csv_is_the_persisted_table(spark, samples):
    table, csv = scratch_path(spark, "t"), scratch_path(spark, "c")
    sinks.sink_metadata_table(samples.drop("vec"), table)
    sinks.sink_ordered_csv(table, csv, spark, single_file=True)
    rows = spark.read.option("header", True).csv(csv).collect()
    rank = {"train": 0, "val": 1, "test": 2}
    order = [(rank[r["split"]], int(r["split_index"])) for r in rows]
    assert order == sorted(order) and len(rows) == 12
