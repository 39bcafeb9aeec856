"""Run registered queries against their DuckDB oracles.

    python tools/check_oracles.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tests"))

from oracle import compare, duck_connection, type_mismatches  # noqa: E402

from logweave import get_session  # noqa: E402
from logweave.plans import all_oracles, all_queries  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    extra = {}
    if os.environ.get("CHECK_TZ"):  # run under another session time zone
        extra["spark.sql.session.timeZone"] = os.environ["CHECK_TZ"]
    if os.environ.get("CHECK_ANSI"):  # run with ANSI mode on/off
        extra["spark.sql.ansi.enabled"] = os.environ["CHECK_ANSI"]
    spark = get_session("local[8]", **extra)
    con = duck_connection(sf_dir)
    queries, oracles = all_queries(), all_oracles()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                sql = oracles[name].replace("/root/testdata/sf0.01/", sf_dir.rstrip("/") + "/")
                msg = compare(df, con, sql)
                types = type_mismatches(df, con, sql)
                if msg is None and types:
                    msg = "types: " + "; ".join(types)
            else:
                df.count()
                msg = "no oracle (rows only)"
        except Exception as exc:  # report and go on
            msg = f"ERROR {type(exc).__name__}: {str(exc)[:400]}"
        ok = msg is None or msg.startswith("no oracle") or msg.startswith("types")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:32s} {time.time() - t0:6.2f}s {msg or ''}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
