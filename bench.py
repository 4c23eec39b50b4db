"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON with the seconds of each.

Each query runs once to compile and load, then its best of two further runs counts.  Results are written
to Spark's no-op sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import time

from trailmark.registry import QUERIES
from trailmark.session import session

HEADLINE = [
    "kin_acceleration", "kin_speed_stats", "lane_assign_fill", "maneuver_labels", "split_purge", "win_starts_prefix", "sample_steps", "sample_masks", "ped_windows",
    "resample_linear", "decimate_weights", "ego_transform", "graph_interpolate", "graph_radius", "graph_node_type", "knn_agents", "radius_pairs", "mode_ade",
    "met_minade", "met_minapde", "met_missrate", "met_collision", "met_brier", "met_expde", "met_nll_mvn", "loss_ewta", "csr_interval_join", "token_join",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
