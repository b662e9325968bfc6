"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_RUNS     timed runs per query after one warm-up (default 3; the median counts)
BENCH_QUERIES  comma list of query names instead of the headline set
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievemark.plans import registry  # noqa: E402
from sievemark.session import local_session  # noqa: E402

HEADLINE = [
    "vector_stats", "content_hash", "record_uuid", "qc_summary", "class_balance", "duplicate_count",
    "duplicate_peer_ids", "duplicate_label_conflicts", "extreme_records", "low_variance_rows",
    "dedup_drop_conflicts", "dedup_report", "stratified_split", "assigned_index", "split_fingerprint",
    "auc_rank", "roc_points", "select_threshold", "threshold_metrics", "predict_table", "model_rank",
    "join_catalog", "catalog_facets", "kpi_tiles", "split_metrics", "page", "ingest_merge_content",
    "ingest_merge_sources", "rescore_catalog", "feature_moments", "linear_attribution", "attribution_pixels",
    "flatten_features", "normalize_label",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    queries, _ = registry.load()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 4)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec",
        "queries": seconds, "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
