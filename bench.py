"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from treelark.plans import catalogue

HEADLINE = [
    "bm25_search", "search_context", "tokenize_terms", "idf_table", "excerpts", "pack_budget", "dir_edges", "find_related", "dir_proximity", "impact_files", "unique_symbols", "caller_sets",
    "policy_forbid_import", "policy_require_test_file", "policy_evidence_requires", "dir_fingerprint", "semantic_fingerprint", "freshness_summary", "health_aggregate", "token_economics",
    "arm_category_matrix", "snapshot_diff", "fingerprint_transitions", "hotspots", "href_extraction", "debounce_sessions", "state_transitions",
]


def main() -> None:
    root, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalogue.queries()
    found["token_economics"](spark, root).collect()  # starts the session's machinery; not counted
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, root).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": root.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
