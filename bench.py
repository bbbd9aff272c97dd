"""Benchmark of the headline queries.

Runs each query of HEADLINE at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints one JSON line. Every query is executed to
completion through the ``noop`` sink (all rows computed, nothing collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from geotrail.plans import catalog  # noqa: E402
from geotrail.session import build_session, scratch_scope  # noqa: E402

HEADLINE = ["clean_posts", "reciprocal_edges", "l1_median", "propagate_5", "holdout_error",
            "mobile_share_by_country", "flatten_posts", "clean_posts_b"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="geotrail-bench")
    # warm the JVM (class loading, codegen caches) on the smallest input, untimed
    catalog.QUERIES["reciprocal_edges"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        with scratch_scope(spark):
            t0 = time.perf_counter()
            catalog.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[k] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
