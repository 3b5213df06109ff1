"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores.  The derived tables are written first and timed as ``load_tables``; each query
then runs once to its last row (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trailmetrics.plans.registry import all_queries  # noqa: E402
from trailmetrics.sources.driver_tables import load_tables  # noqa: E402

HEADLINE = [
    "analytics_summary", "analytics_top_tools", "list_workflows", "list_active_workflows",
    "mode_distribution", "mode_comparison", "timeline", "execution_graph_edges", "bottlenecks",
    "savings", "performance_over_time", "trace_timeline", "runs_by_type",
    "task_clusters", "cluster_detail", "group_detail", "group_conformance", "group_distinct_paths",
    "guidance", "optimization_context",
    "traces", "directly_follows_graph", "process_model", "model_quality", "detect_patterns",
    "find_pareto_paths", "failure_warnings", "decision_tree_by_band", "generate_suggestions",
    "mode_significance", "cluster_by_embedding",
    "shipping_quotes", "promotion_checks", "wallet_ledger", "keyword_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    times: dict[str, float] = {}
    began = time.time()
    load_tables(spark, sf_dir).traces  # noqa: B018  (stored on first use)
    times["load_tables"] = round(time.time() - began, 3)
    for name in names:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    total = sum(t for n, t in times.items() if n != "load_tables")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(total, 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
