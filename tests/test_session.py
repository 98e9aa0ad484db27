"""Scratch paths without a configured folder, and the entry without the
packages that only the corpus operators need."""

import os
import subprocess
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLAIN = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from slotvalue.session import scratch_path
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
one, two = scratch_path(spark, "a"), scratch_path(spark, "a")
assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
spark.range(5).write.parquet(one)
assert spark.read.parquet(one).count() == 5
print("FINE")
"""


def run(script: str) -> str:
    conf = tempfile.mkdtemp(prefix="no-conf-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": conf}
    out = subprocess.run([sys.executable, "-c", script], cwd=conf, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_scratch_path_in_a_session_without_configuration():
    assert "FINE" in run(PLAIN)


@pytest.mark.parametrize("blocked", ["xxhash", "zstandard", "tokenizers", "public_tokenizers", "corpus_pipeline", "slotvalue.llm"])
def test_entry_without_a_package_of_the_corpus_part(blocked):
    found = run(f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules[{blocked!r}] = None\n"
                "import warnings; warnings.simplefilter('ignore')\n"
                "import __spark_entry__ as E; print(len(E.queries()), all(k in E.queries() for k in E.oracle_sql()), 'slot_value' in E.queries())")
    count, oracles, there = found.split()
    assert int(count) >= 32 and oracles == there == "True"
