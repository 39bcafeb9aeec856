"""Time the events-based queries on the given tables and on an N-times copy.

    python tools/scale_check.py <sf_dir> <scratch_dir> [copies=20] [files=40]

The copy (``events`` only, fresh ids, many files so scans run in parallel)
is written once to ``<scratch_dir>/events.parquet``.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from pyspark.sql import functions as F  # noqa: E402

from logweave import get_session  # noqa: E402
from logweave.plans import all_queries  # noqa: E402

NAMES = ["w1_request_records", "w7_record_json", "r1_reconcile", "a1_token_count", "t2_window_token_counts",
         "a3_json_key_counter", "a4_grouped_values", "n1_strict_get", "c6_to_time", "h3_pseudonymised_records"]


def main() -> None:
    sf, scratch = sys.argv[1].rstrip("/"), sys.argv[2].rstrip("/")
    copies = int(sys.argv[3]) if len(sys.argv) > 3 else 20
    n_files = int(sys.argv[4]) if len(sys.argv) > 4 else 40
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "16", "spark.driver.memory": "16g"})
    target = f"{scratch}/events.parquet"
    if not os.path.exists(target):
        ev = spark.read.parquet(f"{sf}/events.parquet")
        big = ev.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_c"))
        big = big.withColumn("event_id", F.col("event_id") + F.col("_c") * 10**7).drop("_c")
        big.repartition(n_files).write.parquet(target)
    q = all_queries()
    for d in (sf, scratch):
        for name in NAMES:
            best = float("inf")
            for _ in range(2):
                t0 = time.perf_counter()
                q[name](spark, d).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - t0)
            print(f"{os.path.basename(d):12s} {name:28s} {best:6.2f}s", flush=True)


if __name__ == "__main__":
    main()
