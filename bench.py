"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs in full into a
sink that keeps nothing, BENCH_RUNS times (2), and its fastest run counts: the first one
also pays for compiling code in a fresh session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from commentlab.plans import ENTRIES  # noqa: E402
from commentlab.session import local_session  # noqa: E402

HEADLINE = [
    "clean_aggressive", "clean_minimal", "feature_text", "stem_text", "word_ngrams", "char_ngrams",
    "class_terms_by_lift", "class_terms_by_document_lift", "length_profile", "feature_quality",
    "split_leakage", "confidence_profile", "dedup_by_text", "balanced_subset", "balanced_subset_large",
    "stratified_split", "stratified_split_orders", "sample_exact", "round_robin_order",
    "rebuild_balanced", "parse_annotations", "cohen_kappa", "flatten_answers", "job_state",
    "upsert_fields", "insert_skipping_duplicates", "group_by_remainder", "tfidf_weights", "bias_grid",
    "model_scores_per_run", "per_class_metrics", "flatten_json", "eda_report",
    "naive_bayes_test_predictions", "embedding_classifier", "stream_landing",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    spark.read.parquet(f"{sf}/nation.parquet").count()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    took = {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            ENTRIES[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    label = os.path.basename(sf.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": label}))


if __name__ == "__main__":
    main()
