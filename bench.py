"""Time the headline jobs; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagequarry.plans.queries import QUERIES  # noqa: E402
from pagequarry.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "page_stats",
    "classify_as_coded",
    "extracted_links",
    "main_fields",
    "paragraph_fields",
    "matched_labels",
    "table_items",
    "candidate_blocks",
    "best_blocks",
    "processed_pages",
    "processed_stored_pages",
    "checked_items",
    "link_graph",
    "crawl",
    "pulled_records",
    "push_plan",
    "streamed_pages",
]


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.showConsoleProgress": "false",
            # the tables here are single files of one row group
            "spark.pagequarry.partitions": CPUS,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        runs = []
        # the first run warms the session and the workers
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
