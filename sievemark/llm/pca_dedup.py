"""Embedding near-dedup: PCA-ordered tiles, compared on leading dimensions first."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import batch_of, column_of
from sievemark.llm.components import connected_components, local_roots
from sievemark.session import materialize

THRESHOLD = 0.93
TILE = 2048
ROWS_AT_ONCE = 256
GRID_DIMENSIONS = 2
STEPS = 4
SLACK = 1e-9

PREPARED = pa.schema([
    ("vec_id", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("vector", pa.binary()), ("vector_key", pa.binary()),
])
PREPARED_DDL = "vec_id long, label long, size int, vector binary, vector_key binary"


def prepare(embeddings: DataFrame) -> DataFrame:
    """Vectors as doubles with a key of their values; size 0 marks a row that links with nothing."""

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = column_of(batch, "label")
            sizes, vectors, keys = [], [], []
            for label, values in zip(labels, column_of(batch, "embedding"), strict=True):
                usable = label is not None and bool(values) and None not in values
                vector = np.array(values, dtype=np.float64) + 0.0 if usable else np.zeros(0)
                if not (np.isfinite(vector).all() and vector.any()):
                    vector = np.zeros(0)
                sizes.append(vector.size)
                vectors.append(vector.tobytes())
                keys.append(hashlib.blake2b(vectors[-1], digest_size=16).digest())
            yield batch_of(PREPARED, vec_id=column_of(batch, "vec_id"), label=labels, size=sizes, vector=vectors, vector_key=keys)

    return embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).mapInArrow(prepared, PREPARED_DDL)


def unit_rows(vectors: list[bytes], size: int) -> np.ndarray:
    """Vectors as rows of length one; scaled by the largest part first, so that no square overflows."""
    x = np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


MOMENT = pa.schema([("size", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector size, the axes of the second moments of unit vectors, by falling variance.

    Each task sums its outer products, Spark sums the tasks'; a size-by-size
    matrix reaches the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array(column_of(batch, "size"))
            vectors = column_of(batch, "vector")
            for size in np.unique(sizes).tolist():
                x = unit_rows([vectors[i] for i in np.flatnonzero(sizes == size)], size)
                totals[size] = totals.get(size, 0) + x.T @ x
        for size, total in totals.items():
            i, j = np.nonzero(np.ones_like(total))
            yield batch_of(MOMENT, size=[size] * i.size, i=i, j=j, total=total[i, j])

    rows = (
        classes.select("size", "vector").mapInArrow(moments, "size int, i int, j int, total double")
        .groupBy("size", "i", "j").agg(F.sum("total").alias("total")).collect()
    )
    sums: dict[int, np.ndarray] = {}
    for r in rows:
        sums.setdefault(r["size"], np.zeros((r["size"], r["size"])))[r["i"], r["j"]] = r["total"]
    return {size: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for size, m in sums.items()}


def tile_links(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit rows with cosine at or above the threshold.

    Both sides are turned to the principal axes. Leading dimensions are
    multiplied first; what the rest can add is at most the product of the
    suffix norms, and a pair that cannot reach the threshold is dropped before
    the next step. The survivors' cosines are taken on the given coordinates.
    """
    size = axes.shape[0]
    cuts = np.unique(np.linspace(0, size, STEPS + 1).astype(int))
    a, b = left @ axes, right @ axes
    rest_a, rest_b = ([np.sqrt(np.maximum((x[:, c:] ** 2).sum(axis=1), 0)) for c in cuts[1:]] for x in (a, b))
    found_i, found_j = [], []
    for low in range(0, a.shape[0], ROWS_AT_ONCE):
        block = slice(low, low + ROWS_AT_ONCE)
        head = a[block, : cuts[1]] @ b[:, : cuts[1]].T
        alive = head + rest_a[0][block, None] * rest_b[0][None, :] >= threshold - SLACK
        if same:
            alive &= np.arange(b.shape[0])[None, :] > np.arange(low, low + head.shape[0])[:, None]
        i, j = np.nonzero(alive)
        sums = head[i, j]
        i += low
        for step in range(1, len(cuts) - 1):
            if not i.size:
                break
            sums = sums + np.einsum("nd,nd->n", a[i, cuts[step] : cuts[step + 1]], b[j, cuts[step] : cuts[step + 1]])
            stay = sums + rest_a[step][i] * rest_b[step][j] >= threshold - SLACK
            i, j, sums = i[stay], j[stay], sums[stay]
        if i.size:
            stay = np.einsum("nd,nd->n", left[i], right[j]) >= threshold
            found_i.append(i[stay])
            found_j.append(j[stay])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (empty, empty)


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
CELL = ["label", "size", *[f"g{k}" for k in range(GRID_DIMENSIONS)]]


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link when their labels are equal and not NULL, their vectors have the
    same length, and the cosine in double precision is at least ``threshold``.
    A NULL, empty or zero vector, or one with a NULL or non-finite part, links
    with nothing. Equal vectors form one class first and are counted, not
    compared. Classes of a label are put in cells along the leading principal
    axes, as wide as two linked unit vectors can lie apart, so that links lie
    in the same or neighbouring cells; cells are cut into tiles of at most
    about ``TILE`` classes and tile pairs are compared, one task group each.
    No pair is kept but those that join a component's rows to its first.
    An empty table gives no row.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    prepared = materialize(prepare(embeddings), "vectors")
    classes = materialize(
        prepared.filter("size > 0").groupBy("label", "size", "vector_key")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("vector").alias("vector"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    axes = principal_axes(classes)
    width = max(np.sqrt(2 - 2 * threshold), 1e-3) * (1 + 1e-9)

    placed_schema = pa.schema([("class", pa.int64()), *[(f"g{k}", pa.int64()) for k in range(GRID_DIMENSIONS)]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(column_of(batch, "size"))
            vectors = column_of(batch, "vector")
            cells = np.zeros((sizes.size, GRID_DIMENSIONS), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                lead = unit_rows([vectors[i] for i in rows], size) @ axes[size][:, :GRID_DIMENSIONS]
                cells[rows, : lead.shape[1]] = np.floor(lead / width)
            yield batch_of(placed_schema, **{"class": column_of(batch, "class")}, **{f"g{k}": cells[:, k] for k in range(GRID_DIMENSIONS)})

    grid = classes.select("class", "size", "vector").mapInArrow(
        place, "class long, " + ", ".join(f"g{k} long" for k in range(GRID_DIMENSIONS))
    )
    placed = materialize(classes.select("class", "label", "size", "copies", "vector").join(grid, "class"), "placed")
    tiled = placed.groupBy(*CELL).agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    cells = materialize(tiled.withColumn("cell", F.monotonically_increasing_id()), "cells")

    steps = [s for s in itertools.product((-1, 0, 1), repeat=GRID_DIMENSIONS) if s >= (0,) * GRID_DIMENSIONS]
    neighbours = cells.select(
        "label", "size", F.col("cell").alias("left_cell"), F.col("tiles").alias("left_tiles"),
        F.explode(F.array(*[
            F.struct(*[(F.col(f"g{k}") + s[k]).alias(f"g{k}") for k in range(GRID_DIMENSIONS)]) for s in steps
        ])).alias("at"),
    ).select("label", "size", "left_cell", "left_tiles", "at.*")
    pairs = neighbours.join(cells.withColumnsRenamed({"cell": "right_cell", "tiles": "right_tiles"}), CELL)
    units = materialize(
        pairs.withColumn("left_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left_tiles") - 1)))
        .withColumn("right_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("right_tiles") - 1)))
        .filter("left_cell <> right_cell OR left_tile <= right_tile")
        .select("left_cell", "left_tile", "right_cell", "right_tile").withColumn("unit", F.monotonically_increasing_id()),
        "units",
    )
    same = F.lit(0) + ((F.col("left_cell") == F.col("right_cell")) & (F.col("left_tile") == F.col("right_tile"))).cast("int")
    sides = units.select("unit", F.col("left_cell").alias("cell"), F.col("left_tile").alias("tile"), F.lit(0).alias("side"), same.alias("same")).union(
        units.filter("left_cell <> right_cell OR left_tile <> right_tile").select("unit", "right_cell", "right_tile", F.lit(1), F.lit(0))
    )
    members = placed.join(cells, CELL).select(
        "class", "size", "copies", "vector", "cell", F.pmod(F.xxhash64("class"), F.col("tiles")).alias("tile")
    )

    def compare(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        size = rows["size"][0].as_py()
        vectors = rows["vector"].to_pylist()
        class_, copies = rows["class"].to_numpy(), rows["copies"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        itself = bool(rows["same"][0].as_py())
        if itself:
            right = left
        if not left.size or not right.size:
            return FOUND.empty_table()
        x = unit_rows([vectors[i] for i in left], size)
        y = x if itself else unit_rows([vectors[i] for i in right], size)
        i, j = tile_links(x, y, axes[size], threshold, itself)
        i, j = left[i], right[j]
        links = np.bincount(i, weights=copies[j], minlength=side.size) + np.bincount(j, weights=copies[i], minlength=side.size)
        linked = np.flatnonzero(links)
        roots = local_roots(side.size, i, j)
        moved = np.flatnonzero(roots != np.arange(side.size))
        return pa.Table.from_arrays([
            pa.array(np.concatenate([class_[linked], class_[moved]])),
            pa.concat_arrays([pa.nulls(linked.size, pa.int64()), pa.array(class_[roots[moved]], type=pa.int64())]),
            pa.array(np.concatenate([links[linked].astype(np.int64), np.zeros(moved.size, dtype=np.int64)])),
        ], schema=FOUND)

    found = materialize(members.join(sides, ["cell", "tile"]).groupBy("unit").applyInArrow(compare, "a long, b long, links long"), "links")
    linked = found.filter("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("class"), "root")
    described = (
        classes.select("label", "size", "vector_key", "class", "copies", "first").join(linked, "class", "left").join(roots, "class", "left")
        .select("label", "size", "vector_key", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "class").alias("root"))
    )
    firsts = described.groupBy("root").agg(F.min("first").alias("component_id"))
    by_vector = described.join(firsts, "root").select("label", "size", "vector_key", "links", "component_id")
    rows = prepared.select("vec_id", "label", "size", "vector_key").join(by_vector, ["label", "size", "vector_key"], "left")
    usable = F.col("size") > 0
    component = F.when(usable, F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.select(
        "vec_id", F.when(usable, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
