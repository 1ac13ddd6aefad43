"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds for each and their sum."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from corvane import registry

HEADLINES = (
    "k4_where_search", "f6_require_all", "k5_did_you_mean", "k7_rank_top_n", "w3_budget_plan", "k9_bm25", "k12_echo_evaluate", "k16_secret_scan", "p33_redact",
    "j1_cochange_pairs", "j2_cochange_partners", "a6_digest", "a1_heat_buckets", "s5_tree_rollup", "v1_build_contract", "v2_verify", "j12_manifest_diff",
    "j21_focus", "j22_focus_two_hops", "k14_reference_counts", "u1_merge_strands", "w4_merge_ranges", "j7_excerpt", "f1_ignore_rules",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or [n for n in HEADLINES if n in registry.QUERIES]
    for name in names[:2]:  # warm the JVM
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
