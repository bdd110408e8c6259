"""Runs the headline queries and prints one JSON line. Settings: BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

from sitegauge.plans import catalog
from sitegauge.session import build

HEADLINE = [
    "site_overview", "page_signals", "rules_local", "dup_documents", "copy_corpus_scan", "site_score", "lifecycle_upsert",
    "lifecycle_resolve_local", "reuse_decision", "finding_groups", "policy_matrix", "site_row", "scan_progress", "scan_complete",
    "link_edges", "plan_batches", "stream_stage_durations", "q_search_findings", "export_findings_wide",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "4")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    queries["plan_batches"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
