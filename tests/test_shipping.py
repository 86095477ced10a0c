"""Operators with Python workers must run from any working directory and any session."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
from oddone.operators.vectors import near_far_counts
rows = [(i, "k%d" % (i % 4), [float(i)]) for i in range(8)]
cand = spark.createDataFrame(rows, "pos long, key string, vec array<double>")
print("ROWS", near_far_counts(cand, 2.0, 5.0).count())
"""


def test_worker_code_ships_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="oddone-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 4" in out.stdout, out.stderr[-2000:]
