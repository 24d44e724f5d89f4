"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from tabulon.session import build_session
from tabulon.workload import registry

HEADLINE = [
    "profile_customer", "profile_pages", "distinct_counts", "value_distribution", "target_candidates",
    "impute_mean", "zscore", "label_encode", "correlation_pairs", "correlation_filter", "variance_filter",
    "pca_scores", "reduction_run", "text_tokens", "vocabulary", "bag_of_words", "tfidf", "chi2_top_terms",
    "text_feature_vectors", "kmeans_labels", "kmeans_sweep", "exact_silhouette", "ward_labels", "cluster_run",
    "bayes_fit", "bayes_probabilities", "best_split", "forest_predict", "logistic_predict", "hash_split",
    "stratified_folds", "roc_auc", "ovr_auc", "weighted_f1", "row_documents", "nearest_documents", "prompt_assembly",
    "answer_cleanup", "extract_numbers", "batch_predict", "text_classification_run", "regression_run",
    "csv_of_many_blocks", "tree_walk", "random_search", "nearest_documents_blocks", "roles_by_sketch", "question_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "20g"})
    spark.sparkContext.setLogLevel("OFF")
    queries = registry().queries
    # The first query would pay for starting the engine and its Python workers.
    queries["answer_cleanup"](spark, "/root/testdata/sf0.001" if os.path.exists("/root/testdata/sf0.001") else sf_dir).count()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
