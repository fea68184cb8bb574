"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of sample tables; BENCH_CPUS: local cores; BENCH_RUNS: timed runs per
query, of which the fastest counts (after one warm-up run).
"""

from __future__ import annotations

import json
import os
import re
import time

from geotrail.plans.checked import QUERIES
from geotrail.session import build_session

HEADLINE = [
    "point_in_polygon_pairs",
    "inside_set",
    "spatial_join_grid",
    "collision_events",
    "collision_events_setdiff",
    "visits",
    "current_polygon_set",
    "latest_location",
    "latest_by_user",
    "active_users",
    "history_in_interval",
    "trajectory_one_user",
    "trajectories_by_user",
    "trajectory_pages",
    "polygons_catalog",
    "visits_history",
    "currently_inside",
    "event_json_keyed",
    "reject_split",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        # The sample is small: let its shuffles use all local cores.
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt and (best is None or took < best):
                best = took
        seconds[name] = round(best, 3)
    spark.stop()
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
