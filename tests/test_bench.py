"""bench.py runs end to end and prints one JSON line (the driver parses it)."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_WARMUP="0")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "north_star",
                          "funnel"], capture_output=True, text=True, env=env, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["metric"] == "total_query_time" and rec["unit"] == "sec"
    assert set(rec["queries"]) == {"north_star", "funnel"} and rec["sf"] == 0.001
    assert rec["value"] > 0
