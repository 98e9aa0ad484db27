"""The queries run in a session started elsewhere: executors have no package
on their path."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
KEYS = ["op2_quality", "op4_warc", "op5_decontam", "op6_langid", "op7_substring", "op9_ann", "op10_tokens",
        "op11_divergence", "op12_urls", "op13_veccodes"]
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate()
import __spark_entry__ as E
for key in {KEYS!r}:
    print("ROWS", key, E.queries()[key](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="elsewhere-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    rows = {x.split()[1]: int(x.split()[2]) for x in out.stdout.splitlines() if x.startswith("ROWS")}
    assert set(rows) == set(KEYS) and all(rows.values())
