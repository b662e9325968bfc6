"""Ingest state rules, versioned scoring, streaming and the catalog view."""

import datetime as dt
import hashlib
import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, png_bytes
from sievemark import schemas as S
from sievemark.functions.raster import axis_weights, gray_features
from sievemark.operators import catalog, dedup, ingest, splits, tiles
from sievemark.plans import flows
from sievemark.session import materialize, scratch_path
from sievemark.sources import files
from sievemark.streaming.ingest import CatalogStore, stream_ingest

BATCH = ("path string, filename string, content_id string, file_size bigint, format string, width bigint, height bigint,"
         " color_mode string, exif string, features array<double>, decode_error string, split string, label bigint,"
         " seen_at timestamp, read_error string")
T0 = dt.datetime(2024, 1, 1)
SCORER = ingest.Scorer(lambda f: f[0], 0.5, "probability", "v1")


def row(path, content="c1", *, fmt="PNG", features=(0.7,), broken=None, unread=None, split=None, label=None, at=0, size=10):
    ok = broken is None and unread is None
    return (path, path.split("/")[-1], None if unread else content, size, fmt if ok else None, 28 if ok else None,
            14 if ok else None, "L" if ok else None, "{}" if ok else None, list(features) if ok else None, broken, split,
            label, T0 + dt.timedelta(seconds=at), unread)


@pytest.fixture()
def store(spark):
    return CatalogStore(spark, scratch_path(spark, "store"))


def apply(store, change, rows, **options):
    store.apply(store.spark.createDataFrame(rows, BATCH), change, **options)


def contents(store):
    return {r["content_id"]: r for r in store.content().collect()}


def view(store):
    return {r["path"]: r for r in catalog.add_outcomes(catalog.join_catalog(store.sources(), store.content())).collect()}


def test_directory_and_replay(spark, tmp_path):
    gray = np.arange(16, dtype=np.uint8).reshape(4, 4)
    os.makedirs(tmp_path / "nested")
    for name in ("first.PNG", "nested/copy.png"):
        (tmp_path / name).write_bytes(png_bytes(gray))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_bytes(b"text")
    store = CatalogStore(spark, scratch_path(spark, "store"))
    flows.ingest_directory(store, str(tmp_path), 0, feature_count=16)
    got = {p.split("/")[-1]: r for p, r in view(store).items()}
    assert {n: r["processing_status"] for n, r in got.items()} == {
        "first.PNG": "awaiting_model", "copy.png": "awaiting_model", "bad.png": "failed", "notes.txt": "unsupported"}
    assert got["first.PNG"]["copies"] == 2 and got["first.PNG"]["format"] == "PNG" and got["first.PNG"]["width"] == 4
    assert got["first.PNG"]["content_id"] == hashlib.sha256(png_bytes(gray)).hexdigest()
    good = contents(store)[got["first.PNG"]["content_id"]]
    assert good["features"] == [float(v) for v in range(16)]
    flows.ingest_directory(store, str(tmp_path), 1, feature_count=16)
    assert all(c["attempts"] == (0 if c["processing_status"] == "unsupported" else 1) for c in contents(store).values())
    flows.ingest_directory(store, str(tmp_path), 2, feature_count=16)
    counts = {r["status"]: r["n"] for r in ingest.batch_statuses(store.sources(), store.content()).collect()}
    assert counts == {"awaiting_model": 2, "failed": 1, "unsupported": 1}


def test_bounded_scan(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"x" * 10)
    (tmp_path / "large.bin").write_bytes(b"x" * 100)
    got = {r["filename"]: r for r in files.scan_bounded(spark, str(tmp_path), limit=50).collect()}
    assert got["large.bin"]["content"] is None and got["large.bin"]["read_error"] == "File exceeds 50 bytes"
    assert bytes(got["small.bin"]["content"]) == b"x" * 10 and got["small.bin"]["read_error"] is None


def test_decoded_images_keep_failures(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png_bytes(np.zeros((3, 5))))
    (tmp_path / "b.png").write_bytes(b"junk")
    got = {r["path"].split("/")[-1]: r for r in files.scan_decoded_images(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["decode_error"]) == (5, 3, None)
    assert got["b.png"]["width"] is None and got["b.png"]["decode_error"]


@pytest.mark.parametrize("head, expected", [
    (b"\x89PNG\r\n\x1a\nrest", "PNG"), (b"\xff\xd8\xff\xe0xxxxxxxx", "JPEG"), (b"BMxxxxxxxxxx", "BMP"),
    (b"II*\x00xxxxxxxx", "TIFF"), (b"RIFF1234WEBPxx", "WEBP"), (b"RIFF1234WAVExx", None), (b"", None),
])
def test_format_by_first_bytes(spark, head, expected):
    assert spark.range(1).select(files.sniffed_format(F.lit(head))).first()[0] == expected


def test_retry_counts_attempts(store):
    broken = [row("a/x.png", broken="bad data")]
    apply(store, 0, broken)
    assert contents(store)["c1"]["attempts"] == 1
    apply(store, 1, broken)
    assert contents(store)["c1"]["attempts"] == 1
    apply(store, 2, broken, retry_failed=True)
    assert contents(store)["c1"]["attempts"] == 2
    assert contents(store)["c1"]["processing_status"] == "failed"


def test_corrected_file_moves_to_its_new_content(store):
    apply(store, 0, [row("a/x.png", "old", broken="bad")])
    apply(store, 1, [row("a/x.png", "new", at=5)])
    assert view(store)["a/x.png"]["content_id"] == "new"
    assert view(store)["a/x.png"]["processing_status"] == "awaiting_model"
    assert set(contents(store)) == {"old", "new"}


def test_bad_names_do_not_downgrade(store):
    apply(store, 0, [row("a/x.txt")])
    assert contents(store)["c1"]["processing_status"] == "unsupported" and contents(store)["c1"]["attempts"] == 0
    apply(store, 1, [row("a/x.png", at=1)])
    assert contents(store)["c1"]["processing_status"] == "awaiting_model"
    apply(store, 2, [row("b/x.txt", at=2), row("b/y.jpg", at=2)])
    assert contents(store)["c1"]["processing_status"] == "awaiting_model" and contents(store)["c1"]["attempts"] == 1
    got = view(store)
    assert got["b/x.txt"]["error"] == "Unsupported extension"
    assert got["b/y.jpg"]["error"] == "Extension does not match decoded format"
    assert {got[p]["processing_status"] for p in ("a/x.txt", "b/x.txt", "b/y.jpg")} == {"unsupported"}


def test_mismatched_name_alone_is_not_scored(store):
    apply(store, 0, [row("a/x.jpg")], scorer=SCORER)
    assert contents(store)["c1"]["processing_status"] == "awaiting_model"
    apply(store, 1, [row("a/x.png", at=1)], scorer=SCORER)
    assert contents(store)["c1"]["processing_status"] == "complete"


def test_oversized_upload(store):
    apply(store, 0, [row("a/x.png", size=S.MAX_FILE_BYTES + 1)], max_bytes=S.MAX_FILE_BYTES)
    assert view(store)["a/x.png"]["error"] == "File exceeds 25 MiB"


def test_no_limit_unless_the_caller_sets_one(store):
    apply(store, 0, [row("a/x.png", size=S.MAX_FILE_BYTES + 1)], scorer=SCORER)
    assert contents(store)["c1"]["processing_status"] == "complete"


def bmp_bytes(cells: np.ndarray) -> bytes:
    """A 24-bit bitmap of (height, width, blue-green-red) cells."""
    height, width, _ = cells.shape
    lines = b"".join(row.astype(np.uint8).tobytes() + bytes(-3 * width % 4) for row in cells[::-1])
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(lines), 0, 54, 40, width, height, 1, 24, 0, len(lines), 2835, 2835, 0, 0) + lines


def plain_features(cells: np.ndarray, side: int) -> list[float]:
    """Gray values by hand, cell by cell."""
    gray = [[float((int(r) * 19595 + int(g) * 38470 + int(b) * 7471 + 32768) // 65536) for b, g, r in row] for row in cells]

    def along(line: list[float]) -> list[float]:
        step = len(line) / side
        out = []
        for k in range(side):
            shares = [max(0.0, 1 - abs(c + 0.5 - (k + 0.5) * step) / max(step, 1.0)) for c in range(len(line))]
            out.append(math.floor(sum(s * v for s, v in zip(shares, line)) / sum(shares) + 0.5 + 1e-9))
        return out

    columns = zip(*[along(row) for row in gray])
    return [float(v) for row in zip(*[along(list(c)) for c in columns]) for v in row]


def test_images_of_any_size_and_colour_get_features(spark, tmp_path):
    small = np.arange(16, dtype=np.uint8).reshape(4, 4)
    (tmp_path / "small.png").write_bytes(png_bytes(small))
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").limit(12).collect()
    pictures = {}
    for k, r in enumerate(rows):
        height, width = (12, 16) if k < 8 else (40 + k, 3 + k)
        data = np.resize((np.abs(np.array(r["embedding"])) * 1000).astype(np.uint8), height * width * 3) + np.arange(height * width * 3, dtype=np.uint8)
        pictures[f"p{k}.bmp"] = data.reshape(height, width, 3)
        (tmp_path / f"p{k}.bmp").write_bytes(bmp_bytes(pictures[f"p{k}.bmp"]))
    got = {r["filename"]: r for r in files.file_batch(spark, str(tmp_path)).collect()}
    assert len(got) == 13 and not any(r["decode_error"] for r in got.values())
    assert all(len(r["features"]) == 784 for r in got.values())
    for name, cells in pictures.items():
        assert list(got[name]["features"]) == plain_features(cells, 28)
        assert got[name]["color_mode"] == "RGB" and got[name]["width"] == cells.shape[1]
    same = files.file_batch(spark, str(tmp_path), feature_count=16).where("filename = 'small.png'").first()
    assert list(same["features"]) == [float(v) for v in small.ravel()] and same["color_mode"] == "L"
    limited = files.file_batch(spark, str(tmp_path), feature_count=16, max_pixels=9).where("filename = 'small.png'").first()
    assert limited["decode_error"] == "Image exceeds 9 pixels"
    with pytest.raises(ValueError):
        files.file_batch(spark, str(tmp_path), feature_count=10)


def test_pictures_that_are_none(spark):
    rows = spark.createDataFrame(
        [(1, 2, 2, 1, bytearray(b"1234")), (2, 2, 2, 3, bytearray(b"1234")), (3, 0, 2, 1, bytearray(b"")), (4, None, 2, 1, bytearray(b"12")),
         (5, 1, 1, 2, bytearray(b"12")), (6, 1, 1, 4, None), (7, 1, 1, 4, bytearray(b"abcd"))], "k int, w int, h int, c int, data binary")
    got = {r["k"]: r["f"] for r in rows.select("k", gray_features(F.col("w"), F.col("h"), F.col("c"), F.col("data"), 2, 2).alias("f")).collect()}
    assert list(got[1]) == [49.0, 50.0, 51.0, 52.0] and len(set(got[7])) == 1
    assert all(got[k] is None for k in (2, 3, 4, 5, 6))
    assert rows.limit(0).select(gray_features(F.col("w"), F.col("h"), F.col("c"), F.col("data"), 2, 2)).count() == 0


@pytest.mark.parametrize("before, after", [(28, 28), (1, 5), (5, 1), (16, 28), (100, 28), (7, 3)])
def test_axis_weights(before, after):
    weights = axis_weights(before, after)
    assert weights.shape == (after, before) and weights.sum(axis=1) == pytest.approx(np.ones(after)) and (weights.sum(axis=0) > 0).all()
    assert weights == pytest.approx(weights[::-1, ::-1]) and (before != after or (weights == np.eye(before)).all())


def test_unreadable_keeps_name_split_and_label(store):
    apply(store, 0, [row("a/x.png", split="val", label=1)])
    apply(store, 1, [("a/x.png", "?") + row("a/x.png", unread="gone", at=3)[2:]])
    got = view(store)["a/x.png"]
    assert (got["filename"], got["split"], got["label"], got["content_id"]) == ("x.png", "val", 1, None)
    assert (got["processing_status"], got["error"], got["copies"]) == ("failed", "gone", 0)
    apply(store, 2, [row("a/new.png", unread="gone")])
    assert view(store)["a/new.png"]["split"] == "external"


def test_missing_split_reads_as_external(store):
    apply(store, 0, [row("a/x.png")])
    assert view(store)["a/x.png"]["split"] == "external"


def test_same_bytes_twice_in_one_batch(store):
    apply(store, 0, [row("a/x.png"), row("a/y.png")])
    assert len(contents(store)) == 1 and contents(store)["c1"]["attempts"] == 1
    assert {r["copies"] for r in view(store).values()} == {2}


def test_last_row_of_a_path_wins(store):
    apply(store, 0, [row("a/x.png", "new", at=9), row("a/x.png", "old", at=1)])
    assert view(store)["a/x.png"]["content_id"] == "new"


def test_versions_and_rescoring(store):
    rows = [row(f"a/{i}.png", f"c{i}", features=(0.2 + 0.3 * i,)) for i in range(3)]
    apply(store, 0, rows + [row("a/copy.png", "c0", features=(0.2,)), row("a/bad.png", "c9", broken="bad")], scorer=SCORER)
    assert {c: r["predicted_class"] for c, r in contents(store).items()} == {
        "c0": "normal", "c1": "pneumonia", "c2": "pneumonia", "c9": None}
    new = ingest.Scorer(lambda f: f[0], 0.6, "probability", "v2")
    assert ingest.stale_predictions(store.content(), "v2").count() == 3
    assert store.rescore(new, 1).count() == 3
    assert contents(store)["c1"]["predicted_class"] == "normal"
    assert contents(store)["c9"]["processing_status"] == "failed" and contents(store)["c9"]["model_version"] is None
    assert ingest.stale_predictions(store.content(), "v2").count() == 0
    assert store.rescore(new, 2).count() == 0


def test_unusable_scores_are_isolated_and_kept_until_retry(store):
    apply(store, 0, [row("a/1.png", "c1"), row("a/2.png", "c2", features=(7.0,))], scorer=SCORER)
    got = contents(store)
    assert got["c1"]["processing_status"] == "complete"
    assert got["c2"]["processing_status"] == "model_error" and got["c2"]["features"] == [7.0]
    assert got["c2"]["model_version"] == "v1" and got["c2"]["predicted_class"] is None
    fixed = ingest.Scorer(lambda f: f[0] / 10, 0.5, "probability", "v1")
    apply(store, 1, [row("a/2.png", "c2", features=(7.0,))], scorer=fixed)
    assert contents(store)["c2"]["processing_status"] == "model_error"
    apply(store, 2, [row("a/2.png", "c2", features=(7.0,))], scorer=fixed, retry_failed=True)
    assert contents(store)["c2"]["processing_status"] == "complete"


def test_scorer_rejects_bad_thresholds():
    for threshold, kind in ((1.5, "probability"), (float("nan"), "margin"), (float("inf"), "margin")):
        with pytest.raises(ValueError):
            ingest.Scorer(lambda f: f[0], threshold, kind, "v")


def test_pipeline_version_forces_extraction(spark):
    first = spark.createDataFrame([row("a/x.png")], BATCH)
    old = materialize(ingest.merge_content(spark.createDataFrame([], S.CONTENT), first, pipeline_version="0"))
    again = ingest.merge_content(old, first).first()
    assert (again["attempts"], again["pipeline_version"]) == (2, "1")


def test_dataset_ingest_uses_assigned_splits(spark, store):
    """20/6/6 records, one test record equal to a train record: one excluded, the rest in splits."""
    rng = np.random.default_rng(0)
    rows = []
    for split, n in (("train", 20), ("val", 6), ("test", 6)):
        for i in range(n):
            vec = rng.integers(0, 256, 4).astype(float).tolist()
            if (split, i) == ("test", 0):
                vec = rows[0][3]
            rows.append((split, i, rows[0][2] if (split, i) == ("test", 0) else i % 2, vec,
                         hashlib.sha256(repr(vec).encode()).hexdigest()))
    samples = spark.createDataFrame(rows, "split string, split_index bigint, label int, vec array<double>, content_hash string")
    manifest = flows.build_split_table(samples, scratch_path(spark, "splits"))
    flows.ingest_dataset(store, samples, manifest, "set", 2, 2, 0)
    got = view(store)
    excluded = [r["filename"] for r in got.values() if r["split"] == "excluded"]
    assert len(got) == 32 and excluded == ["test_000000.png"]
    apply(store, 1, [row("up/extra.png", "other")])
    assert view(store)["up/extra.png"]["split"] == "external"


def test_conflicting_dataset_is_all_excluded(spark, store):
    vec, h = [1.0, 2.0], "b" * 64
    rows = [(s, i, i, vec, h) for s in ("train", "val", "test") for i in (0, 1)]
    samples = spark.createDataFrame(rows, "split string, split_index bigint, label int, vec array<double>, content_hash string")
    manifest = splits.split_manifest(splits.build_splits(dedup.pool_splits(samples.drop("vec"))))
    flows.ingest_dataset(store, samples, manifest, "set", 2, 1, 0)
    assert {r["split"] for r in view(store).values()} == {"excluded"} and len(contents(store)) == 1


def test_stream_equals_batch_and_replay_changes_nothing(spark, store):
    rows = [row(f"p/{i}.{'png' if i % 4 else 'txt'}", f"c{i % 7}", features=(0.1 * (i % 7),), at=i) for i in range(40)]
    landing = scratch_path(spark, "landing")
    spark.createDataFrame(rows, BATCH).repartition(4).write.parquet(landing)
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(landing)
    point = scratch_path(spark, "cp")
    stream_ingest(stream, store, point, scorer=SCORER)
    other = CatalogStore(spark, scratch_path(spark, "store"))
    apply(other, 0, rows, scorer=SCORER)

    def state(s):
        return {p: (r["content_id"], r["processing_status"], r["predicted_class"], r["copies"]) for p, r in view(s).items()}

    assert state(store) == state(other)
    stream_ingest(stream, store, point, scorer=SCORER)  # nothing new to read
    apply(other, 0, rows, scorer=SCORER)  # a repeated batch overwrites its own change set
    assert state(store) == state(other)
    assert state(store.compact(scratch_path(spark, "store"))) == state(store)


@pytest.fixture(scope="module")
def shown(spark):
    schema = ("path string, filename string, split string, processing_status string, predicted_class string, format string,"
              " outcome string, confidence double, width int, height int, file_size bigint, copies bigint, content_id string,"
              " processed_at timestamp")
    rows = [
        ("d/sample.png", "sample.png", "train", "complete", "normal", "PNG", "correct", 0.9, 10, 20, 100, 2, "c1", T0),
        ("d/100%_x.png", "100%_x.png", "val", "complete", "pneumonia", "PNG", "unlabeled", 0.6, 30, 5, 300, 2, "c1", T0),
        ("d/corrupt.png", "corrupt.png", "external", "failed", None, None, "unlabeled", None, None, None, None, 0, None, None),
        ("Other/z.jpg", "z.jpg", "test", "unsupported", None, "JPEG", "unlabeled", None, 50, 50, 900, 1, "c2", T0),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("settings, expected", [
    ({}, 4), ({"search": "SAMPLE"}, 1), ({"search": "no-match"}, 0), ({"search": "%_"}, 1), ({"search": "other/"}, 1),
    ({"statuses": ["complete"], "splits": ["val"]}, 1), ({"min_confidence": 0.7}, 3),
    ({"min_confidence": 0.7, "include_unclassified": False}, 1), ({"min_width": 1}, 3), ({"max_bytes": 300}, 3),
    ({"only_duplicates": True}, 2), ({"formats": ["PNG"], "outcomes": ["correct"]}, 1),
])
def test_filters(shown, settings, expected):
    assert catalog.kpis(catalog.filter_catalog(shown, catalog.Filters(**settings))).first()["records"] == expected


def test_sort_puts_missing_last_both_ways(shown):
    up = [r["path"] for r in catalog.sort_catalog(shown, "confidence").collect()]
    down = [r["path"] for r in catalog.sort_catalog(shown, "confidence", True).collect()]
    assert up == ["d/100%_x.png", "d/sample.png", "Other/z.jpg", "d/corrupt.png"]
    assert down == ["d/sample.png", "d/100%_x.png", "Other/z.jpg", "d/corrupt.png"]
    with pytest.raises(ValueError):
        catalog.sort_catalog(shown, "label")


@pytest.mark.parametrize("top_k_rows", [0, 100])
def test_pages_are_clamped_and_positions_agree(shown, top_k_rows):
    def paths(number, **kw):
        return sorted(r["path"] for r in catalog.page(shown, number, 3, "file_size", top_k_rows=top_k_rows, **kw).collect())

    assert paths(1) == ["Other/z.jpg", "d/100%_x.png", "d/sample.png"] == paths(-5)
    assert paths(2) == ["d/corrupt.png"] == paths(99)
    for descending in (False, True):
        order = [r["path"] for r in catalog.sort_catalog(shown, "file_size", descending).collect()]
        got = [catalog.position_of(shown, p, "file_size", descending).first()["position"] for p in order]
        assert got == [0, 1, 2, 3]


def test_readable_fields(spark):
    df = spark.createDataFrame([("k", 0.5, 123456.789, None, float("nan"), "x", 1e-3 / 3)],
                               "path string, a_score double, big double, gone string, undefined double, plain string, small double")
    got = {r["field"]: r["value"] for r in catalog.field_value_rows(df, "path").collect()}
    assert got == {"path": "k", "a score": "0.5", "big": "123457", "gone": "—", "undefined": "—", "plain": "x",
                   "small": "0.000333333"}


@pytest.mark.parametrize("value", [0.0, 1e-13, 1.5e-7, 1234567.0, 999999.5, 1e30, -2.5e-5, 100000.0, 0.0001, 3.0, float("inf"), float("-inf")])
def test_six_digits(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(catalog.six_digits(F.col("v"))).first()[0] == f"{value:.6g}"


def test_bad_json_gives_no_fields(spark):
    df = spark.createDataFrame([("a", '{"k_x": "1", "e": ""}'), ("b", "{broken"), ("c", None)], "path string, exif string")
    got = {(r["record_key"], r["field"], r["value"]) for r in catalog.json_fields(df, "path", "exif").collect()}
    assert got == {("a", "EXIF k x", "1"), ("a", "EXIF e", "—")}


def test_id_requests(spark):
    ids = [f"00000000-0000-5000-8000-00000000000{i}" for i in range(4)]
    df = spark.createDataFrame([(i,) for i in ids[:3]], "record_id string")
    found, missing = catalog.resolve_ids(df, f" {ids[2].upper()},{ids[0]},{ids[2]},{ids[3]}")
    assert [r["record_id"] for r in found.orderBy("ordinal").collect()] == [ids[2], ids[0]]
    assert [r["record_id"] for r in missing.collect()] == [ids[3]]
    assert catalog.resolve_ids(df, "ALL")[0].count() == 3
    for bad in ("", " , ", "not-an-id"):
        with pytest.raises(ValueError):
            catalog.resolve_ids(df, bad)


def test_a_batch_reads_only_the_folders_of_its_keys(spark, store):
    from sievemark.streaming.ingest import PARTS, part_of
    from test_scale_helpers import plan_of

    apply(store, 0, [row(f"p/{i}.png", f"c{i}", at=i) for i in range(300)], scorer=SCORER)
    apply(store, 1, [row("p/7.png", "c7", at=900)], scorer=SCORER)
    batch = spark.createDataFrame([row("p/7.png", "c7"), row("p/8.png", "c8"), row("p/x.png", None, unread="lost")], BATCH)
    wanted = {r["p"] for r in batch.where("content_id IS NOT NULL").select(part_of(F.col("content_id")).alias("p")).collect()}
    assert len(wanted) < PARTS
    found = store.content(2, only=batch)
    plan = plan_of(found)
    assert all("part#" in line for line in plan.splitlines() if "PartitionFilters" in line)
    assert {r["content_id"] for r in found.collect()} == {"c7", "c8"}
    assert store.sources(1, only=batch).where("path = 'p/7.png'").first()["seen_at"] == T0 + dt.timedelta(seconds=7)
    assert store.sources(2, only=batch).where("path = 'p/7.png'").first()["seen_at"] == T0 + dt.timedelta(seconds=900)
    assert store.content().count() == 300 and store.content(0).count() == 0


# --- maintained counts


def counted(tiles_table):
    return {(r["facet"], r["value"]): r["n"] for r in tiles_table.collect()}


def test_tiles_follow_every_change(spark, store):
    """Ingest, replay, a moved path, a broken file, a lost file and a rescore: the counts equal a full recount each time."""
    view_of = lambda s, c: catalog.add_outcomes(catalog.join_catalog(s, c))
    now = (materialize(store.sources()), materialize(store.content()))
    kept = materialize(tiles.count_tiles(view_of(*now)))
    steps = [
        [row("a/x.png"), row("a/y.png"), row("a/n.txt", "c2"), row("b/broken.png", "c3", broken="bad"), row("b/j.jpg", "c4")],
        [row("a/x.png"), row("a/y.png")],
        [row("a/y.png", "c5", at=4), row("a/n.txt", "c5", at=4)],
        [("a/x.png", "?") + row("a/x.png", unread="gone", at=5)[2:]],
        [row("b/broken.png", "c6", at=6), row("b/other.png", "c3", broken="bad", at=6)],
    ]
    for change, batch in enumerate(steps):
        apply(store, change, batch, scorer=SCORER if change else None)
        after = (materialize(store.sources()), materialize(store.content()))
        changed = [store._changes(t, None).where(F.col("change") == change) for t in ("sources", "content")]
        kept = materialize(tiles.change_tiles(kept, now, after, *changed))
        assert counted(kept) == counted(tiles.count_tiles(view_of(*after))), change
        again = materialize(tiles.change_tiles(kept, after, after, *changed))
        assert counted(again) == counted(kept)
        now = after
    due = materialize(store.rescore(SCORER, len(steps)))
    after = (now[0], materialize(store.content()))
    kept = materialize(tiles.change_tiles(kept, now, after, now[0].limit(0), due))
    full = view_of(*after)
    assert counted(kept) == counted(tiles.count_tiles(full))
    for kept_form, whole in (
        (tiles.kpis(kept), catalog.kpis(full)), (tiles.facet_values(kept), catalog.facet_values(full)),
        (tiles.value_distributions(kept), catalog.value_distributions(full)), (tiles.status_counts(kept), catalog.status_counts(full)),
        (tiles.catalog_stamp(kept), catalog.catalog_stamp(full)),
    ):
        columns = sorted(whole.columns)
        assert sorted(map(tuple, kept_form.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))


def test_tiles_of_nothing(spark):
    none = (spark.createDataFrame([], S.SOURCES), spark.createDataFrame([], S.CONTENT))
    empty_tiles = tiles.count_tiles(catalog.add_outcomes(catalog.join_catalog(*none)))
    assert empty_tiles.count() == 0
    assert tuple(tiles.kpis(empty_tiles).first()) == (0, 0, 0, 0) and tiles.catalog_stamp(empty_tiles).first()["last_processed_at"] is None
    assert tiles.change_tiles(empty_tiles, none, none, *none).count() == 0
