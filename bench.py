"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then once timed, its whole result counted through
the noop sink, so no rows travel to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trendloom.plans import catalog
from trendloom.session import get_session

HEADLINE = (
    "daily_entity_series", "signal_detection", "brand_rollup", "carry_forward", "latest_snapshot", "range_rows", "dashboard_kpis", "top_movers",
    "similar_by_shared", "emerging_phrases", "resolve_documents", "creator_scores", "note_brand_share", "note_co_occurrence", "topic_distribution", "bigram_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", int(os.environ.get("BENCH_CPUS", "8")), shuffle_partitions=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
