"""bench.py prints exactly one JSON line with the fields the driver reads."""
import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line(sf_small):
    env = dict(os.environ, BENCH_SF_DIR=sf_small, BENCH_CPUS="2", BENCH_RUNS="1",
               BENCH_QUERIES="build_corpus,dedupe_first_wins", BENCH_DRIVER_MEM="2g")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd=ROOT,
                         capture_output=True, text=True, timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert out.returncode == 0 and len(lines) == 1, out.stderr[-2000:]
    b = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(b)
    assert b["unit"] == "sec" and set(b["queries"]) == {"build_corpus", "dedupe_first_wins"}
