"""Time the headline queries; prints one JSON line.

Each query runs twice to completion (no result is kept); the second run counts, the
first warms file caches and the JIT.
"""

from __future__ import annotations

import json
import os
import time

from logloom.plans import catalog
from logloom.session import local_session

HEADLINE = [
    "a12_normalize_entry", "a13_normalize_batch_accounting", "a27_stream_query", "a28_dashboard_query", "a30_admission",
    "a39_correlated", "a40_preceding_entries", "a41_fixed_window_memory", "a43_aligned_window", "a47_fingerprint",
    "a49_worklist", "a51_recent_occurrences", "a55_severity_stats", "a68_subscription_sync", "b20_relation_through",
    "b39_ranking", "b52_query_stats", "b57_repeated_queries", "b63_method_share", "b74_shipping_rate", "c01_issue_rollup", "c06_spikes",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    times, cold = {}, {}
    for name in only or HEADLINE:
        for record in (cold, times):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            record[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total warm seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": sf}))


if __name__ == "__main__":
    main()
