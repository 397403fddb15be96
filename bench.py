"""Time the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

The figures of `queries` are over the bound columns held in memory, as ingest counts in neither of the baseline's figures;
those of `uncached` read Parquet each time, and those of `duckdb` are its own on the same files. All are medians of whole
queries after a warm-up.
"""

from __future__ import annotations

import json
import os
from statistics import median

from millrace.plans.compare import compare
from millrace.plans.queries import QUERIES
from millrace.session import local_session
from millrace.sources import read_lineitem
from millrace.telemetry import Timer, force

HEADLINE = [q for q in QUERIES if q[0] == "q" and q[1:3].isdigit()]
WARM, RUNS = 2, 5


def timed(spark, sf_dir: str) -> dict[str, float]:
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(WARM + RUNS):
            with Timer(name) as t:
                force(QUERIES[name](spark, sf_dir))
            runs.append(t.seconds)
        seconds[name] = round(median(runs[WARM:]), 4)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="millrace-bench")
    uncached = timed(spark, sf_dir)
    held = read_lineitem(spark, sf_dir).cache()
    force(held)
    seconds = timed(spark, sf_dir)
    held.unpersist()
    duck = {r.query: round(r.duckdb_ms / 1000, 4) for r in compare(spark, sf_dir, HEADLINE, runs=3)}
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "uncached": uncached, "duckdb": duck}))
    spark.stop()


if __name__ == "__main__":
    main()
