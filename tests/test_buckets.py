"""Tables stored in buckets of a key: equal results, and no shuffle of what is stored."""

from datetime import datetime, timedelta
import re

import pytest
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.operators import catalog, ingest, metadata
from sievemark.session import materialize, scratch_path
from sievemark.sources.buckets import open_bucketed, upsert_bucketed, write_bucketed

T0 = datetime(2024, 1, 1)
HOT = 20


def content_row(key, status="complete", size=10):
    known = dict(content_id=key, file_size=size, format="PNG", width=4, height=2, aspect_ratio=2.0, processing_status=status, attempts=1)
    return tuple(known.get(f) for f in S.CONTENT.fieldNames())


def source_row(path, key, status="accepted"):
    known = dict(path=path, filename=path, content_id=key, split="train", source_status=status, seen_at=T0 + timedelta(seconds=1))
    return tuple(known.get(f) for f in S.SOURCES.fieldNames())


@pytest.fixture(scope="module")
def state(spark):
    """One content with a third of all sources, sources without content, and sources of a content that is not stored."""
    keys = ["hot"] * 40 + [None] * 25 + [f"c{i % 30}" for i in range(55)] + ["lost"] * 3
    sources = spark.createDataFrame([source_row(f"p{i}", k, "accepted" if i % 7 else "failed") for i, k in enumerate(keys)], S.SOURCES)
    content = spark.createDataFrame([content_row(k) for k in ["hot", *(f"c{i}" for i in range(30)), "unused"]], S.CONTENT)
    return materialize(sources.repartition(5), "sources"), materialize(content, "content")


@pytest.fixture
def planned(spark):
    """Plans as they are before any is changed at run time, with every join on shuffled sides."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def scans(df):
    """(stored in buckets and read so, below a shuffle) of every scan of a stored table, from the physical plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found, above = [], []
    for line in lines:
        at = len(re.match(r"[^A-Za-z]*", line)[0])
        above = [(a, shuffles) for a, shuffles in above if a < at]
        if "FileScan" in line and "sievemark_" in line:
            found.append(("Bucketed: true" in line, any(s for _, s in above)))
        above.append((at, bool(re.search(r"\bExchange\b", line))))
    return found


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("hot_rows", [HOT, 1_000_000])
def test_catalog_equals_plain_join(state, hot_rows):
    sources, content = state
    stored = write_bucketed(sources, "content_id", hot_rows=hot_rows), write_bucketed(content, "content_id", hot_rows=hot_rows)
    assert stored[0].hot_keys == (hot_rows == HOT) and stored[1].hot_keys == 0
    assert stored[0].spread.count() == (65 if hot_rows == HOT else 25)
    joined = catalog.join_stored(*stored)
    plain = catalog.join_catalog(sources, content)
    assert joined.columns == plain.columns and rows_of(joined) == rows_of(plain)
    assert rows_of(stored[0].rows()) == rows_of(sources)


def test_catalog_join_shuffles_no_stored_table(state, planned):
    stored = [write_bucketed(df, "content_id") for df in state]
    found = scans(catalog.join_stored(*stored))
    assert len(found) == 3 and set(found) == {(True, False)}
    # The same tables without their buckets are shuffled: the check of the plan sees it.
    shuffled = catalog.join_catalog(stored[0].regular, stored[1].regular)
    assert any(below for _, below in scans(shuffled))


def test_hot_keys_are_joined_without_shuffling_sources(state, planned):
    stored = [write_bucketed(df, "content_id", hot_rows=HOT) for df in state]
    found = scans(catalog.join_stored(*stored))
    assert len(found) == 4 and set(found) == {(True, False)}


def test_merge_reads_stored_content_in_place(spark, state, planned):
    stored = write_bucketed(state[1], "content_id")
    schema = ("path string, filename string, content_id string, file_size bigint, format string, width bigint, height bigint, color_mode string,"
              " exif string, features array<double>, decode_error string, split string, label bigint, seen_at timestamp, read_error string")
    rows = [(f"n{i}.png", f"n{i}.png", k, 7, "PNG", 4, 4, "L", "{}", [1.0], None, "train", 1, T0, None) for i, k in enumerate(["c1", "new", "new", "hot"])]
    batch = spark.createDataFrame(rows, schema)
    merged = ingest.merge_content(stored.regular, batch, pipeline_version="next")
    assert scans(merged) == [(True, False)]
    changed = materialize(merged, "changed")
    after = upsert_bucketed(stored, changed)
    assert rows_of(after.regular) == rows_of(ingest.upsert(state[1], changed, "content_id"))
    assert after.regular.count() == state[1].count() + 1 and stored.regular.count() == state[1].count()
    # One file a bucket again, still read in place: state does not decay with the number of merges.
    again = upsert_bucketed(after, changed)
    assert len(again.regular.inputFiles()) <= again.buckets
    assert rows_of(again.regular) == rows_of(after.regular)
    assert set(scans(catalog.join_stored(write_bucketed(state[0], "content_id"), again))) == {(True, False)}


@pytest.mark.parametrize("hot_rows", [HOT, 1_000_000])
def test_duplicate_flags(spark, hot_rows):
    hashes = ["h"] * 50 + [None] * 9 + [f"x{i // 2}" for i in range(31)]
    rows = [(str(i), h, ["train", "test", None][i % 3 if h == "h" else i // 2 % 3]) for i, h in enumerate(hashes)]
    df = materialize(spark.createDataFrame(rows, "record_id string, content_hash string, split string"), "rows")
    stored = write_bucketed(df, "content_hash", hot_rows=hot_rows)
    assert rows_of(metadata.add_stored_duplicate_flags(stored)) == rows_of(metadata.add_duplicate_flags(df))


def test_duplicate_flags_shuffle_no_row(spark, planned):
    df = spark.range(200).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 70).cast("string").alias("content_hash"), F.lit("train").alias("split"))
    found = scans(metadata.add_stored_duplicate_flags(write_bucketed(df, "content_hash")))
    assert len(found) == 2 and set(found) == {(True, False)}


def test_reopened_table(spark, state, planned):
    path = scratch_path(spark, "kept")
    write_bucketed(state[0], "content_id", buckets=16, hot_rows=HOT, path=path)
    opened = open_bucketed(spark, path)
    assert (opened.key, opened.buckets, opened.hot_keys) == ("content_id", 16, 1)
    assert rows_of(opened.rows()) == rows_of(state[0])
    assert scans(opened.regular.groupBy("content_id").count()) == [(True, False)]
    with pytest.raises(ValueError):
        upsert_bucketed(opened, state[0])


def test_nothing_and_only_null_keys(spark, state):
    empty = [write_bucketed(df.limit(0), "content_id") for df in state]
    assert catalog.join_stored(*empty).count() == 0
    loose = write_bucketed(state[0].where("content_id is null"), "content_id")
    assert rows_of(catalog.join_stored(loose, empty[1])) == rows_of(catalog.join_catalog(state[0].where("content_id is null"), state[1]))
    grown = upsert_bucketed(empty[1], state[1])
    assert rows_of(grown.regular) == rows_of(state[1])


def test_only_hot_keys_are_broadcast_by_a_merge(spark):
    """States and batches are as large as the catalog; by their few columns Spark takes them for small."""
    batch = materialize(spark.createDataFrame([(f"p{i}", f"p{i}.png", f"c{i % 30}", 10, "PNG", [0.5], T0) for i in range(60)],
        "path string, filename string, content_id string, file_size long, format string, features array<double>, seen_at timestamp"
    ).withColumns({c: F.lit(None).cast(t) for c, t in (
        ("width", "long"), ("height", "long"), ("color_mode", "string"), ("exif", "string"), ("decode_error", "string"),
        ("split", "string"), ("label", "long"), ("read_error", "string"),
    )}), "batch")
    content = materialize(ingest.merge_content(spark.createDataFrame([], S.CONTENT), batch), "content")
    sources = materialize(ingest.merge_sources(spark.createDataFrame([], S.SOURCES), batch, content), "sources")
    merges = [
        ingest.merge_content(content, batch), ingest.merge_sources(sources, batch, content), ingest.upsert(sources, sources.limit(9), "path"),
        ingest.batch_statuses(sources, content), catalog.join_catalog(sources, content),
    ]
    for merged in merges:
        assert merged.count() and merged.collect()
        joins = [line for line in merged._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
        assert all("_hot_key" in line for line in joins), joins
