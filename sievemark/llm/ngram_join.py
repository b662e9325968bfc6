"""N-gram Jaccard join: MinHash banding, then verification on whole n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import batch_of, column_of, text_slices, texts_of, whole_text
from sievemark.llm.components import connected_components, local_roots
from sievemark.llm.spans import Words, mix
from sievemark.session import materialize

N_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 100
TILE = 256
DIRECT_PAIRS = 6
COLUMN_BLOCK = 4096


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with probability ``recall``."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError(f"recall {recall} at {threshold} needs more than {max_hashes} hashes")
    return best


def ngram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's lower-cased word n-grams.

    A text with fewer words is one n-gram of all its words; one without words is the empty set.
    """
    hashes, owner = Words([t.lower().encode("utf-8", "surrogatepass") for t in texts]).shingles(n)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        one = np.sort(hashes[a:b])
        out.append(one[np.append(True, one[1:] != one[:-1])] if one.size else one)
    return out


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit keys; equal keys mean that all MinHashes of a band agree. Sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([s.size for s in sets])[:-1]])
    keys = np.zeros((len(sets), bands), dtype=np.uint64)
    factors = multipliers(bands * rows)
    for band in range(bands):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for row in range(rows):
            smallest = np.minimum.reduceat(flat * factors[band * rows + row], starts)
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + smallest)
        keys[:, band] = key
    return keys


SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_key", pa.binary()), ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64())),
])
SIGNED_DDL = "doc_id long, text_key long, set_key binary, n_grams long, bands array<long>"


def row_key(docs: DataFrame) -> list[Column]:
    """What tells one row from another: the id and a hash of the text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key")]


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N_WORDS) -> DataFrame:
    """One row per document: a key of its n-gram set, the set's size and its band keys."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = ngram_sets(texts_of(part), n)
            filled = [i for i, s in enumerate(sets) if s.size]
            keys: list = [[]] * len(sets)
            if filled:
                for i, k in zip(filled, band_keys([sets[i] for i in filled], bands, rows).view(np.int64), strict=True):
                    keys[i] = k
            yield batch_of(
                SIGNED, doc_id=column_of(part, "doc_id"), text_key=column_of(part, "text_key"), bands=keys,
                set_key=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], n_grams=[s.size for s in sets],
            )

    return docs.select(*row_key(docs), whole_text().alias("text")).mapInArrow(signed, SIGNED_DDL)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence blocks over the n-grams that two sets share."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [s.size for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    owner = owner[keep]
    column = (np.cumsum(shared) - 1)[column[keep]]
    counts = np.zeros((n, n), dtype=np.float64)
    for low in range(0, int(column[-1]) + 1 if column.size else 0, COLUMN_BLOCK):
        a, b = np.searchsorted(column, [low, low + COLUMN_BLOCK])
        block = np.zeros((n, COLUMN_BLOCK), dtype=np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        counts += block @ block.T
    return counts


def similar_pairs(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of non-empty sets with Jaccard at or above the threshold; with ``side``, only across sides."""
    n = len(sets)
    if n <= DIRECT_PAIRS:
        found = [
            (i, j)
            for i in range(n) for j in range(i + 1, n)
            if (side is None or side[i] != side[j])
            and min(sets[i].size, sets[j].size) >= threshold * max(sets[i].size, sets[j].size) - 1e-9
            and reaches(np.intersect1d(sets[i], sets[j], assume_unique=True).size, sets[i].size + sets[j].size, threshold)
        ]
        return np.array([p[0] for p in found], dtype=int), np.array([p[1] for p in found], dtype=int)
    sizes = np.array([s.size for s in sets], dtype=np.float64)
    inter = overlaps(sets)
    hit = inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-9
    hit &= np.triu(np.ones((n, n), dtype=bool), 1)
    if side is not None:
        hit &= side[:, None] != side[None, :]
    return np.nonzero(hit)


def reaches(inter: int, total: int, threshold: float) -> bool:
    return inter >= threshold * (total - inter) - 1e-9


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
FOUND_DDL = "a long, b long, links long"


def verify(units: DataFrame, threshold: float, n: int) -> DataFrame:
    """Links inside each unit: per class the rows it links to, and its component's first class.

    A unit is a number of whole small clusters, or two tiles of a large one
    (``left`` and ``right``; equal for a tile against itself).
    """

    def unit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("cluster", "ascending"), ("class", "ascending")])
        cluster, class_, tile, copies = (rows[c].to_numpy() for c in ("cluster", "class", "tile", "copies"))
        out: dict[str, list] = {"a": [], "b": [], "links": []}
        cuts = np.append(np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])), cluster.size)
        for a, b in zip(cuts, cuts[1:], strict=False):
            members = [i for k, i in enumerate(range(a, b)) if not k or class_[i] != class_[i - 1]]
            if len(members) < 2:
                continue
            index = np.array(members)
            sets = ngram_sets([rows["text"][i].as_py() for i in members], n)
            two_tiles = rows["left"][a].as_py() != rows["right"][a].as_py()
            pairs = similar_pairs(sets, threshold, tile[index] if two_tiles else None)
            if not pairs[0].size:
                continue
            links = np.zeros(index.size, dtype=np.int64)
            np.add.at(links, pairs[0], copies[index[pairs[1]]])
            np.add.at(links, pairs[1], copies[index[pairs[0]]])
            for i in np.flatnonzero(links):
                out["a"].append(int(class_[index[i]]))
                out["b"].append(None)
                out["links"].append(int(links[i]))
            roots = local_roots(index.size, *pairs)
            for i in np.flatnonzero(roots != np.arange(index.size)):
                out["a"].append(int(class_[index[i]]))
                out["b"].append(int(class_[index[roots[i]]]))
                out["links"].append(0)
        return pa.Table.from_pydict(out, schema=FOUND)

    return units.groupBy("unit").applyInArrow(unit, FOUND_DDL)


def jaccard_classes(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_key, class_id, n_links, kept) of every row.

    Texts link when the Jaccard similarity of their sets of lower-cased word
    n-grams is at least ``threshold``. ``n_links`` counts the other rows a row
    links to, copies included; ``class_id`` is the smallest doc_id reachable
    by links; ``kept`` marks the class's first row (by id, NULL last, then
    text); copies under one id and text are all marked. A text of fewer than
    ``n`` words is a single n-gram; a text without words links with nothing
    and forms a class of its own. An empty table gives no row.

    Rows with equal sets form one class first, so copies never meet each
    other. Only band keys are shuffled to find candidates; clusters of
    candidates are verified on whole sets, each text shipped once, or, in
    clusters above ``TILE`` classes, once per tile it is compared with.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = materialize(signatures(docs, bands, rows, n), "signatures")
    classes = materialize(
        signed.filter("n_grams > 0").groupBy("set_key").agg(
            F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")).alias("first"),
            F.min("bands").alias("bands"),
        ).withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    banded = classes.select("class", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("class").alias("hub"), F.count("*").alias("size")).filter("size > 1").select("band", "hub")
    candidates = banded.join(hubs, "band").filter("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    clusters = connected_components(candidates).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    few = F.col("size") <= TILE
    tiles = F.ceil(F.col("size") / TILE).cast("long")
    members = materialize(
        clusters.join(sizes, "cluster").join(classes, "class").select(
            "cluster", "class", "copies", "first.doc_id", "first.text_key", "size",
            F.when(few, F.lit(0)).otherwise(F.pmod(F.xxhash64("class"), tiles)).cast("long").alias("tile"),
            F.when(few, F.lit(1)).otherwise(tiles).alias("tiles"),
        ),
        "members",
    )
    groups = max(1, -(-members.count() // TILE))
    keyed = docs.select(*row_key(docs), whole_text().alias("text"))
    same = keyed["doc_id"].eqNullSafe(members["doc_id"]) & (keyed["text_key"] == members["text_key"])
    # Merged at every size: a plan that broadcasts small members would change its cost with the input.
    texts = keyed.join(members.hint("merge"), same).select("cluster", "class", "copies", "text", "tile", "tiles")
    if not signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty():
        texts = texts.dropDuplicates(["class"])
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    left, right = F.least("tile", "other"), F.greatest("tile", "other")
    units = texts.select(
        "cluster", "class", "copies", "text", "tile", left.alias("left"), right.alias("right"),
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(
            F.xxhash64("cluster", left, right).bitwiseOR(F.lit(1 << 62)) ).alias("unit"),
    )
    found = materialize(verify(units, threshold, n), "links")
    linked = found.filter("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("class"), "root")
    placed = classes.join(linked, "class", "left").join(roots, "class", "left").select(
        "set_key", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root"),
    )
    firsts = placed.groupBy("root").agg(F.min("first").alias("group_first"))
    described = placed.join(firsts, "root").select("set_key", (F.col("links") + F.col("copies") - 1).alias("n_links"), "group_first")
    joined = signed.select("doc_id", "text_key", "set_key", "n_grams").join(described, "set_key", "left")
    alone = F.col("n_grams") == 0
    first = (F.col("group_first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("group_first.text_key") == F.col("text_key"))
    return joined.select(
        "doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("group_first.doc_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (alone | first).alias("kept"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class of similar texts, with all its columns.

    Rows without words all stay.
    """
    decided = materialize(jaccard_classes(docs, **options), "classes")
    repeated = decided.filter("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).filter("rows > 1")
    names = docs.columns
    dropped = decided.filter("NOT kept").select(F.col("doc_id").alias("gone"), F.col("text_key").alias("gone_key")).distinct()
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *row_key(docs))
    stay = keyed.join(dropped.hint("merge"), keyed["doc_id"].eqNullSafe(dropped["gone"]) & (keyed["text_key"] == dropped["gone_key"]), "left_anti")
    if not repeated.isEmpty():
        has_words = F.regexp_count(F.coalesce("row.text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) > 0
        worded = stay.filter(has_words).dropDuplicates(["doc_id", "text_key"])
        stay = worded.unionByName(stay.filter(~has_words))
    return stay.select("row.*")
