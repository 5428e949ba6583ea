"""The entry module: optional parts, and workers that cannot import the package."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

RUN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
known = entry.queries()
for name in {names!r}:
    assert known[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def alone(code, folder):
    """Runs code in a process of its own, in another folder and without a path to the package."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED")}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=600)


@pytest.mark.parametrize("names", [["iforest_scores", "ema_drift", "cooldown", "block_status"], ["stream_blocks"]])
def test_workers_need_no_package(tmp_path, names):
    done = alone(RUN.format(root=ROOT, names=names), tmp_path)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_parts_may_be_missing(tmp_path):
    """Without the corpus folders, or without something that they need, the other queries are there."""
    shutil.copytree(f"{ROOT}/packetrisk", tmp_path / "packetrisk", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    count = "import sys, warnings; sys.path.insert(0, '.'); {}; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    done = alone(count.format("pass"), tmp_path)
    assert done.stdout.split()[2] == "False" and int(done.stdout.split()[0]) > 40 and "left out" in done.stderr
    done = alone(f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()))", tmp_path)
    assert int(done.stdout.split()[0]) > 40 and "xxhash" in done.stderr
