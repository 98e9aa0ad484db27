"""The contract works from a fresh default session started outside the
repository (executors must not need the package on their path)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
print("ROWS", E.entry(spark).count(), E.queries()["entity_key"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="elsewhere-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("ROWS")][0]
    assert int(line.split()[1]) > 0 and int(line.split()[2]) > 0
