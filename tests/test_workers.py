"""Queries whose tasks run Python, on workers that cannot import this package."""

import os
import subprocess
import sys


REPO = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
NAMES = ["user_avg", "user_avg_sql", "log_rule_many", "first_match_intervals", "first_match_intervals_spread", "stream_continuous_state", "stream_sink", "stream_replay"]
SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as contract
from pulsewatch.session import build_session
spark = build_session("elsewhere", "local[2]", {{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": os.getcwd() + "/shared"}})
spark.sparkContext.setLogLevel("OFF")
def importable(_):
    try:
        import pulsewatch
    except ImportError:
        yield 0
    else:
        yield 1
assert spark.sparkContext.parallelize([1], 1).mapPartitions(importable).collect() == [0]
for name in {names!r}:
    print(name, contract.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def run_elsewhere(names, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = os.path.join(folder, "run.py")
    with open(script, "w") as out:
        out.write(SCRIPT.format(repo=os.path.abspath(REPO), names=names))
    done = subprocess.run([sys.executable, script], cwd=folder, env=env, capture_output=True, text=True, timeout=1500)
    assert done.returncode == 0, done.stderr[-3000:]
    return dict(line.split() for line in done.stdout.splitlines() if line.split()[:1] and line.split()[0] in names)


def test_queries_run_on_workers_without_the_package(tmp_path):
    assert set(run_elsewhere(NAMES, str(tmp_path))) == set(NAMES)
