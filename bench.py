"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is forced with a no-op write (full computation, nothing collected).
``BENCH_QUERIES`` (comma list) overrides the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidewell.plans.registry import HEADLINE, QUERIES, load_all
    from tidewell.session import local_session
    load_all()
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="tidewell-bench")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    # warm-up outside the timings: JVM code paths and the Python worker start once
    spark.range(1000).selectExpr("sum(id)").collect()
    times, failed = {}, {}
    for name in names:
        spark.catalog.clearCache()  # no query profits from what another one cached
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as exc:  # one query must not cost the others their figures
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "failed": failed, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
