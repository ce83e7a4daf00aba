"""Workers get the package from the session, wherever the driver was started."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

PROGRAM = """
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
for name in ("ev_dedup_window", "ev_priority_limits", "stream_token_bucket"):
    print("rows", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_python_operators_run_without_a_path_variable(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = PROGRAM.format(entry=str(REPO / "__spark_entry__.py"))
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("rows ") == 3, done.stderr[-2000:]
