"""The pipeline's stages on the smallest tables: each keeps to what it was given."""

from collections import Counter

from conftest import SMALL
import corpus_pipeline
from sievemark.llm import mil, surrogates
from sievemark.session import materialize


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, results = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(materialize(stage(spark, results[-1], SMALL), "stage"))
    assert all(r.columns == columns for r in results[:-1])
    given, good, single, private, mixed, packed = results
    accepted = {r["doc_id"] for r in mil.classify(given, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r["predicted"]}
    assert {r["doc_id"] for r in good.collect()} == accepted
    assert {r["doc_id"] for r in single.collect()} < accepted and len({r["text"] for r in single.collect()}) == single.count()
    before = {r["value"] for r in surrogates.distinct_values(single).collect()}
    after = {r["value"] for r in surrogates.distinct_values(private).collect()}
    assert len(before) == len(after) and not before & after
    assert set(Counter(r["doc_id"] for r in mixed.collect()).values()) <= {1, 2}
    rows = packed.collect()
    assert len([r for r in rows if r["piece"] == 0]) == mixed.count()
    assert max(Counter(r["sequence_id"] for r in rows).values()) >= 1
