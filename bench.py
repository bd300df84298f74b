"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("rest_anchor", "window_targets", "macro_score", "speed_bin_report",
            "recording_statistics", "frame_consistency", "lag_correlation", "block_spectrum",
            "stitch_center", "fir_decimate", "reanchored_cumsum", "up_filter", "dead_reckon",
            "weighted_draw", "time_dilation", "stream_rest_scores")


def main() -> None:
    from sensorframe import build_session
    from workload import QUERIES
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus))
    QUERIES["window_targets"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
