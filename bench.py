"""Benchmark: every registered query on $BENCH_SF_DIR, local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (the whole plan
executes, nothing is collected to the driver), ``$BENCH_RUNS`` times (default
2); the best run is reported per query, the first-run total as
``cold_total_sec``. ``$BENCH_EVENT_LOG_DIR`` turns on Spark's event log
(stage and task times) in that folder. Prints one JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweave import get_session  # noqa: E402
from logweave.plans import all_queries  # noqa: E402


def picked(names: list[str], starts: list[str]) -> list[str]:
    """The names that begin with one of `starts` (all without any); a variant, whose
    name goes on after another picked one's, only by a start that goes on as far."""
    out = set()
    for start in starts:
        hits = [n for n in names if n.startswith(start)]
        out.update(n for n in hits if not any(n.startswith(f"{m}_") for m in hits))
    return [n for n in names if not starts or n in out]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    conf = {
        "spark.sql.shuffle.partitions": str(max(cpus * 2, 8)),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
    }
    if os.environ.get("BENCH_EVENT_LOG_DIR"):  # stage and task times, read offline
        conf.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]})
    spark = get_session(f"local[{cpus}]", **conf)
    queries = all_queries()
    # warm the JVM (class loading, codegen caches) outside the timings
    queries["s11_schema_only"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in picked(list(queries), only):
        fn = queries[name]
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        times[name] = round(min(took), 3)   # best run: one-time codegen and class loading excluded
        cold[name] = round(took[0], 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold_total_sec": round(sum(cold.values()), 3),
        "runs_per_query": runs,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
