"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced end to end with the ``noop`` sink (full computation, no collect). One
warm-up run of the flagship query is discarded first (JVM start, file cache).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["daily_trades", "daily_quotes", "log_midpoint_series", "container_events",
            "container_lineitem", "coefficient", "coefficient_period", "slope_summary",
            "z_between_stocks", "z_between_venues", "z_between_periods", "panel_within",
            "z_panel_between_venues", "distribution", "poisson_check", "day_index", "means_over_time"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from ticklens.session import get_session
    from ticklens.plans.catalog import queries

    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8))
    qs = queries()
    wanted = [q for q in (sys.argv[1:] or HEADLINE) if q in qs]
    qs[wanted[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up, discarded
    times = {}
    for name in wanted:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_wall_clock", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
