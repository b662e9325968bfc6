"""Seeded, stratified, leak-free splits over deduplicated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.identity import seeded_order
from sievemark.functions.labels import split_rank
from sievemark.functions.raster import affine, side_of
from sievemark.operators.dedup import dedup_report, deduplicate
from sievemark.operators.ranking import hash_rank, index_rank
from sievemark.operators.skew import broadcast_if_small
from sievemark.session import materialize

# Where the pieces of a SHA-256 begin that the fingerprint adds up: four of 15 hex digits and the last four digits.
FINGERPRINT_LANES = (1, 16, 31, 46, 61)


def check_fractions(val_fraction: float, test_fraction: float) -> None:
    if not (0 < val_fraction < 1 and 0 < test_fraction < 1):
        raise ValueError("val_fraction and test_fraction must be in (0, 1)")
    if val_fraction + test_fraction >= 1:
        raise ValueError("val_fraction + test_fraction must be below 1")


def source_fractions(pooled: DataFrame) -> DataFrame:
    """Validation and test share of the source splits, before deduplication."""
    total = F.count(F.lit(1))
    return pooled.agg(
        F.try_divide(F.count_if(F.col("source_split") == "val"), total).alias("val_fraction"),
        F.try_divide(F.count_if(F.col("source_split") == "test"), total).alias("test_fraction"),
    )


def resolve_fractions(
    pooled: DataFrame, preserve: bool = True, val_fraction: float = 0.1, test_fraction: float = 0.1
) -> tuple[float, float]:
    if preserve:
        row = source_fractions(pooled).first()
        val_fraction, test_fraction = row["val_fraction"] or 0.0, row["test_fraction"] or 0.0
    check_fractions(val_fraction, test_fraction)
    return val_fraction, test_fraction


def _take_quota(counts: DataFrame, available: str, drawn: Column, name: str) -> DataFrame:
    """Share ``drawn`` records over labels by largest remainder (ties: lower label)."""
    everything = Window.partitionBy("_all")
    by_remainder = Window.partitionBy("_all").orderBy(F.col("_rest").desc(), "label")
    return (
        counts.withColumn("_drawn", drawn)
        .withColumn("_exact", F.coalesce(F.try_divide(
            (F.col(available) * F.col("_drawn")).cast("double"),
            F.sum(available).over(everything).cast("double")), F.lit(0.0)))
        .withColumn("_floor", F.floor("_exact"))
        .withColumn("_rest", F.col("_exact") - F.col("_floor"))
        .withColumn("_missing", F.col("_drawn") - F.sum("_floor").over(everything))
        .withColumn("_turn", F.row_number().over(by_remainder))
        .withColumn(name, F.col("_floor") + (F.col("_turn") <= F.col("_missing")).cast("long"))
        .drop("_drawn", "_exact", "_floor", "_rest", "_missing", "_turn")
    )


def split_quotas(kept: DataFrame, val_fraction: float, test_fraction: float) -> DataFrame:
    """Records per label and split: one row per label.

    Sizes follow the ceiling rule for fractional test sizes, first for test
    out of everything and then for validation out of the rest; within a size,
    labels share by largest remainder, the larger side being drawn first.
    """
    check_fractions(val_fraction, test_fraction)
    counts = kept.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    everything = Window.partitionBy("_all")
    total = F.sum("n").over(everything)
    dev = total - F.ceil(F.lit(test_fraction) * total)
    counts = _take_quota(counts, "n", dev, "dev")
    dev_total = F.sum("dev").over(everything)
    share = val_fraction / (1 - test_fraction)
    counts = _take_quota(counts, "dev", dev_total - F.ceil(F.lit(share) * dev_total), "train_quota")
    return counts.select(
        "label",
        "train_quota",
        (F.col("dev") - F.col("train_quota")).alias("val_quota"),
        (F.col("n") - F.col("dev")).alias("test_quota"),
    )


def stratified_split(
    kept: DataFrame, val_fraction: float, test_fraction: float, seed: int = S.DEFAULT_SEED
) -> DataFrame:
    """Assign every retained record to train, val or test.

    The order inside a label is a seeded hash, so the choice is reproducible
    at any parallelism and a label is ranked in 65,536 independent pieces.
    """
    keyed = kept.withColumn("_order", seeded_order(seed, F.col("content_hash")))
    ranked = hash_rank(keyed, ["label"], "_order", "_rank")
    quotas = broadcast_if_small(split_quotas(kept, val_fraction, test_fraction))  # one row per label
    assigned = (
        F.when(F.col("_rank") <= F.col("test_quota"), "test")
        .when(F.col("_rank") <= F.col("test_quota") + F.col("val_quota"), "val")
        .otherwise("train")
    )
    return ranked.join(quotas, "label").select(*kept.columns, assigned.alias("assigned_split"))


def official_split(pooled: DataFrame) -> DataFrame:
    """No deduplication: the source split is the assigned split."""
    return pooled.where(F.col("source_split").isin(*S.MODEL_SPLITS)).select(
        "source_split", "source_index", "pool_rank", "label", "content_hash",
        F.col("source_split").alias("assigned_split"),
    )


def split_manifest(assigned: DataFrame) -> DataFrame:
    """One row per retained record with its 0-based position in its split.

    The assignment is written before it is numbered, since numbering reads it more than once.
    """
    ranked = index_rank(materialize(assigned, "assigned"), ["assigned_split"], F.col("pool_rank"), "source_index", "_position")
    return ranked.select(
        "assigned_split", (F.col("_position") - 1).alias("assigned_index"),
        "source_split", "source_index", "label", "content_hash",
    )


def split_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("assigned_split").agg(F.count(F.lit(1)).alias("size"))


def split_fingerprint(assigned: DataFrame) -> DataFrame:
    """Digest of exactly which hashes are in which split, independent of order.

    Each hash is cut into numbers of up to 60 bits that are summed per split.  The
    sums combine on the map side; gathering and sorting all hashes in one
    place, as a sequential digest needs, does not scale.
    """
    lanes = [
        F.sum(F.conv(F.substring("content_hash", start, 15), 16, 10).cast("decimal(20,0)")).alias(f"lane{start}")
        for start in FINGERPRINT_LANES
    ]
    per_split = assigned.groupBy("assigned_split").agg(F.count(F.lit(1)).alias("n"), *lanes)
    text = F.concat_ws(
        ":", "assigned_split", F.col("n").cast("string"),
        *[F.col(f"lane{start}").cast("string") for start in FINGERPRINT_LANES],
    )
    ordered = F.array_sort(F.collect_list(F.struct(split_rank(F.col("assigned_split")).alias("r"), text.alias("t"))))
    return per_split.agg(
        F.substring(F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), "|"), 256), 1, 16)
        .alias("split_fingerprint")
    )


def repeated_hashes(assigned: DataFrame) -> DataFrame:
    """Hashes that occur more than once, in one split or across splits; empty is right."""
    split = F.when(F.col("assigned_split").isNotNull(), F.xxhash64("assigned_split"))  # numbers aggregate without sorting
    return (
        assigned.groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("occurrences"), (F.min(split) != F.max(split)).alias("across_splits"))
        .where("occurrences > 1")
    )


def split_report(
    pooled: DataFrame, assigned: DataFrame, policy: str, val_fraction: float, test_fraction: float,
    seed: int, preserve: bool,
) -> DataFrame:
    """The one-row report that goes with a manifest."""
    sizes = assigned.agg(
        *[F.count_if(F.col("assigned_split") == s).alias(f"split_size_{s}") for s in S.MODEL_SPLITS]
    )
    return (
        dedup_report(pooled, policy).withColumn("_one", F.lit(1))
        .join(sizes.withColumn("_one", F.lit(1)), "_one")
        .join(split_fingerprint(assigned).withColumn("_one", F.lit(1)), "_one")
        .drop("_one")
        .select(
            F.lit("deduplicate_then_split").alias("strategy"), "*",
            F.lit(seed).alias("random_seed"),
            F.lit(round(val_fraction, 6)).alias("val_fraction"),
            F.lit(round(test_fraction, 6)).alias("test_fraction"),
            F.lit(preserve).alias("preserve_source_proportions"),
        )
    )


def build_splits(
    pooled: DataFrame,
    *,
    deduplicate_records: bool = True,
    policy: str = "drop",
    preserve: bool = True,
    val_fraction: float = 0.1,
    test_fraction: float = 0.1,
    seed: int = S.DEFAULT_SEED,
) -> DataFrame:
    """Deduplicate pooled records, then assign splits."""
    if not deduplicate_records:
        return official_split(pooled)
    val_fraction, test_fraction = resolve_fractions(pooled, preserve, val_fraction, test_fraction)
    # Quotas, ranks and the assignment all read the retained records: shuffle the pool once.
    kept = materialize(deduplicate(pooled, policy), "kept")
    return stratified_split(kept, val_fraction, test_fraction, seed)


def stratified_folds(rows: DataFrame, k: int = S.CV_FOLDS, seed: int = S.DEFAULT_SEED) -> DataFrame:
    """Seeded stratified folds 0..k-1 inside the given rows."""
    if k < 2:
        raise ValueError("k must be at least 2")
    order = seeded_order(seed, F.col("content_hash"))
    if "copy" in rows.columns:  # augmented copies share their hash
        order = F.concat(order, F.lpad(F.col("copy").cast("string"), 10, "0"))
    keyed = rows.withColumn("_order", order)
    return (
        hash_rank(keyed, ["label"], "_order", "_rank")
        .withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int"))
        .drop("_order", "_rank")
    )


def holdout_fold(rows: DataFrame, split: str = "assigned_split") -> DataFrame:
    """-1: always in the fitting part; 0: the single scoring part."""
    return rows.where(F.col(split).isin("train", "val")).withColumn(
        "fold", F.when(F.col(split) == "train", -1).otherwise(0)
    )


def seeded_sample(rows: DataFrame, k: int, key: str, seed: int = S.DEFAULT_SEED) -> DataFrame:
    """``k`` rows without replacement, the same ones on every run."""
    return (
        rows.withColumn("_order", seeded_order(seed, F.col(key)))
        .orderBy("_order", key).limit(k).drop("_order")
    )


def augment_training(
    train: DataFrame, copies: int = 1, *, width: int | None = None, scale: float = 0.03, translate: float = 0.03, rotate: float = 5.0,
    brightness: float = 0.05, contrast: float = 0.05, probability: float = 0.5, seed: int = S.DEFAULT_SEED, top: float = 255.0,
) -> DataFrame:
    """Training rows plus ``copies`` versions, mildly and reproducibly changed.

    With ``probability`` a copy's picture is stretched per axis by up to
    ``scale``, shifted by up to ``translate`` of its size and turned by up to
    ``rotate`` degrees; independently, its contrast and brightness change.
    ``width`` is the picture's; without it squares are told by their size,
    and other vectors only change in contrast and brightness. Draws hang on
    content, copy and seed. NULL vectors stay NULL.
    """
    if copies < 1:
        raise ValueError("copies must be at least 1")

    def unit(tag: str) -> Column:
        key = F.concat_ws(":", F.lit(tag), F.col("content_hash"), F.col("copy").cast("string"))
        digits = F.substring(seeded_order(seed, key), 1, 13)
        return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))

    def around(tag: str, reach: float) -> Column:
        return (unit(tag) * 2 - 1) * reach

    side = side_of(F.col("vec")) if width is None else F.lit(width)
    copied = train.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("_width", side).withColumns({
        "_warp": F.col("_width").isNotNull() & (unit("a") < probability), "_sx": 1 + around("sx", scale), "_sy": 1 + around("sy", scale),
        "_tx": around("tx", translate) * F.col("_width"), "_ty": around("ty", translate) * (F.size("vec") / F.col("_width")),
        "_turn": around("r", rotate), "_apply": unit("p") < probability, "_gain": 1 + around("c", contrast), "_shift": around("b", brightness) * top,
    })
    warped = copied.withColumn("vec", F.when(F.col("_warp"), affine(*map(F.col, ("vec", "_width", "_sx", "_sy", "_tx", "_ty", "_turn")))).otherwise(F.col("vec")))
    changed = F.transform("vec", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(top), x * F.col("_gain") + F.col("_shift"))))
    out = warped.withColumn("vec", F.when(F.col("_apply"), changed).otherwise(F.col("vec")))
    return train.withColumn("copy", F.lit(0)).unionByName(out.select(*train.columns, "copy"))
