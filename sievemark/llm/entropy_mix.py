"""Mixing sources to target sizes by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemark.llm.common import whole_text, word_count
from sievemark.operators.ranking import bucketed_row_number, range_row_number
from sievemark.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
ROUNDS = 80
TOLERANCE = 1e-7
RANK_ROWS = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: position, size, weight, target.

    Sources in code point order, NULL last, take the weights in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source's
    size and the excess is shared again by weight until none is above. Each
    resharing needs two sums over the sources.
    """
    totals = sizes.groupBy("source").agg(
        F.count("*").alias("rows"), F.sum("size").alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"),
    )
    ordered = range_row_number(totals, [F.col("source").asc_nulls_last()], "position")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    sources = materialize(ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "sources")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    unit = 0.0
    while True:
        above = F.col("weight") * unit > F.col("cap")
        fixed, free, n = sources.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
            F.sum(above.cast("int")),
        ).first()
        if not free:
            break
        level = (budget - fixed) / free
        grown = sources.agg(F.sum((F.col("weight") * level > F.col("cap")).cast("int"))).first()[0]
        unit = level
        if grown == n:
            break
    return sources.withColumn("target", F.least("cap", F.col("weight") * unit))


def rate(size: str = "size", tilt: str = "tilt", mean: str = "mean", most: int = MOST):
    """Copies a document is worth: exponentially tilted by its size and stopped at ``most``."""
    return F.exp(F.least(F.col(tilt) * F.col(size) / F.col(mean), F.lit(math.log(most))))


def balance(classes: DataFrame, sources: DataFrame, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """The tilt of each source: Newton iterations on the dual of entropy balancing.

    Rates stay as close to one copy each, in relative entropy, as the token
    constraint of the source and the limit of ``most`` copies allow, which
    makes them exponentials of tilt times size. Each iteration is one
    aggregation over ``classes`` (documents of a source with equal sizes) for
    the dual's slope and curvature; a step that leaves the bracket of the root
    is replaced by its middle.
    """
    top = F.log(F.lit(float(most)))
    x_min = F.col("smallest") / F.col("mean")
    wanted = F.col("target") / F.col("source_size")
    full = F.col("target") >= F.col("cap")
    state = sources.filter("source_size > 0 AND target > 0").withColumn("mean", F.col("source_size") / F.col("rows")).select(
        "position", "target", "mean", F.when(full, top / x_min).otherwise(0.0).alias("tilt"),
        F.when(wanted < 1, F.log(wanted) / x_min).otherwise(0.0).alias("low"),
        F.when(wanted > 1, top / x_min).otherwise(0.0).alias("high"), full.alias("done"),
    )
    state = materialize(state, "tilt")
    for _ in range(rounds):
        value = rate(most=most)
        bent = F.col("tilt") * F.col("size") / F.col("mean") < math.log(most)
        mass = F.col("documents") * F.col("size") * value
        summed = classes.filter("size > 0").join(state, "position").groupBy(*state.columns).agg(
            F.sum(mass).alias("got"), F.sum(F.when(bent, mass * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        error = F.col("got") - F.col("target")
        done = F.col("done") | (F.abs(error) <= F.greatest(F.col("target") * TOLERANCE, F.lit(0.05)))
        low = F.when(error <= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("tilt")).otherwise(F.col("high"))
        bracketed = summed.select("position", "target", "mean", "tilt", low.alias("low"), high.alias("high"), done.alias("done"), "got", "slope")
        step = F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope")
        good = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        tilt = F.when(F.col("done"), F.col("tilt")).when(good, step).otherwise((F.col("low") + F.col("high")) / 2)
        state = materialize(bracketed.withColumn("tilt", tilt).select("position", "target", "mean", "tilt", "low", "high", "done"), "tilt")
        if state.filter("NOT done").isEmpty():
            break
    else:
        raise RuntimeError("the tilts did not converge")
    # Sums of doubles depend on their order in the last digits; rounding keeps reruns equal.
    return state.select("position", F.round("tilt", 10).alias("tilt"), "mean")


def whole_copies(classes: DataFrame, sources: DataFrame, tilts: DataFrame, most: int = MOST) -> DataFrame:
    """``classes`` with ``copies``: whole copies of a class's documents together.

    Running sums of the rates over falling sizes are rounded, so that rounding
    errors do not add up; then copies of the largest class that fits what is
    still missing (or over) are added (or taken away) until none fits. A round
    does so for falling sizes as far as whole classes fit, and for as many
    copies of the next class as do. That at least halves what is missing, so
    the rounds are at most the binary digits of a source's words.
    """
    rated = classes.join(tilts, "position", "left").withColumn(
        "rate", F.when((F.col("size") > 0) & F.col("tilt").isNotNull(), rate(most=most)).otherwise(F.lit(1.0))
    )
    by_size = W.partitionBy("position").orderBy(F.col("size").desc())
    whole = F.floor(F.sum(F.col("documents") * F.col("rate")).over(by_size.rowsBetween(W.unboundedPreceding, 0)) + 0.5)
    rounded = rated.withColumn("until", whole)
    copies = F.col("until") - F.coalesce(F.lag("until").over(by_size), F.lit(0))
    out = materialize(
        rounded.withColumn("copies", F.when(F.col("size") > 0, F.least(copies, F.col("documents") * most)).otherwise(F.col("documents")))
        .select("position", "size", "documents", "rate", "copies"),
        "copies",
    )
    larger = by_size.rowsBetween(W.unboundedPreceding, -1)
    while True:
        missing = out.groupBy("position").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(
            sources.select("position", "target"), "position"
        ).select("position", (F.round("target").cast("long") - F.col("taken")).alias("missing"))
        room = F.when(F.col("missing") > 0, F.col("documents") * most - F.col("copies")).otherwise(F.col("copies"))
        fitting = out.join(missing, "position").filter((F.col("size") > 0) & (F.col("size") <= F.abs("missing"))).withColumn("room", room)
        # What is left after all larger classes; below a size, or 0, once a class has not fitted as a whole.
        left = F.abs("missing") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0))
        step = F.least(F.floor(F.col("left") / F.col("size")), F.col("room")) * F.signum("missing").cast("long")
        steps = fitting.filter("room > 0").withColumn("left", left).filter("left >= size").select("position", "size", step.alias("step"))
        steps = materialize(steps, "steps")
        if steps.isEmpty():
            break
        out = materialize(
            out.join(steps, ["position", "size"], "left")
            .withColumn("copies", (F.col("copies") + F.coalesce("step", F.lit(0))).cast("long"))
            .select("position", "size", "documents", "rate", "copies"),
            "copies",
        )
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: its source's size and target, its copies, and the words these take.

    The size of a document is its number of words (NULL text: 0). A document
    of no words is taken once, at no cost. A NULL source is a source, the
    last. Repeated rows are separate documents. Which of the documents with
    equal source and size get one copy more is decided by a hash of the id, so
    reruns agree. Other columns are not read; an empty table gives no row.

    Row-level work moves ids and sizes only. Rows of one source or size are
    never gathered: sums are combined before the shuffle and ranks are taken
    in buckets of about ``RANK_ROWS`` rows.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(whole_text()).alias("size")
    )
    sizes = materialize(narrow, "sizes")
    sources = materialize(source_targets(sizes, weights, share, most), "targets")
    named = sources.select(F.col("source").alias("name"), "position")
    grouped = sizes.groupBy("source", "size").agg(F.count("*").alias("documents"))
    classes = materialize(
        grouped.join(named, grouped["source"].eqNullSafe(named["name"])).select("position", "source", "size", "documents"), "classes"
    )
    decided = whole_copies(classes.drop("source"), sources, balance(classes, sources, most), most)
    described = decided.join(classes.select("position", "source", "size"), ["position", "size"]).join(
        sources.select("position", "source_size", "target"), "position"
    ).select(
        "position", F.col("source").alias("name"), F.col("size").alias("its_size"), "source_size", "target", "rate", "documents",
        F.floor(F.col("copies") / F.col("documents")).alias("each"), F.pmod("copies", "documents").alias("extra"),
    )
    described = materialize(described, "described")
    rows = materialize(
        sizes.join(described, sizes["source"].eqNullSafe(described["name"]) & (sizes["size"] == described["its_size"])).drop("name", "its_size"),
        "rows",
    )
    mixed = rows.filter("extra > 0")
    bucket = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("documents") / RANK_ROWS))
    ranked = bucketed_row_number(mixed, ["position", "size"], bucket, [bucket, F.xxhash64("doc_id"), F.col("doc_id")], "rank")
    more = (F.col("rank") <= F.col("extra")).cast("long")
    columns = ["doc_id", "source", "size", "source_size", "target", "rate"]
    out = rows.filter("extra = 0").select(*columns, F.col("each").alias("copies")).unionByName(
        ranked.select(*columns, (F.col("each") + more).alias("copies"))
    )
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with all its columns.

    Rows that agree in id, source and size share their copies evenly; where that leaves some over, the first of them get one more.
    """
    decided = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("alike"))
    decided = materialize(
        decided.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "copies", "alike",
                       F.monotonically_increasing_id().alias("class")), "decided"
    )
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("k_id"),
        F.col("source").cast("string").alias("k_source"), word_count(whole_text()).alias("k_size"), F.monotonically_increasing_id().alias("turn"),
    )
    same = F.col("k_id").eqNullSafe(F.col("m_id")) & F.col("k_source").eqNullSafe(F.col("m_source")) & (F.col("k_size") == F.col("m_size"))
    joined = keyed.join(decided.hint("merge"), same).select("row", "turn", "class", "copies", "alike")
    each, over = F.floor(F.col("copies") / F.col("alike")), F.pmod("copies", "alike")
    owned = joined.filter(over == 0).select("row", each.alias("own"))
    if not decided.filter(over > 0).isEmpty():      # where ids are unique, rows are joined once
        bucket = F.pmod(F.xxhash64("turn"), F.ceil(F.col("alike") / RANK_ROWS))
        uneven = bucketed_row_number(joined.filter(over > 0), ["class"], bucket, [bucket, F.col("turn")], "rank")
        owned = owned.unionByName(uneven.select("row", (each + (F.col("rank") <= over).cast("long")).alias("own")))
    return owned.filter("own > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own")))).select("row.*")
