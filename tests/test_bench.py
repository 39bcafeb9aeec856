"""bench.py prints exactly one JSON line in the driver's format."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": SF_SMALL, "BENCH_RUNS": "1", "BENCH_CPUS": "2", "BENCH_DRIVER_MEMORY": "2g"}
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "r1_", "o1_top"], env=env,
                         capture_output=True, text=True, timeout=600, check=True).stdout
    lines = [l for l in out.splitlines() if l.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["metric"] == "total_sec" and d["unit"] == "sec" and d["sf"] == 0.001
    assert set(d["queries"]) == {"r1_reconcile", "o1_top_k"} and d["value"] > 0
