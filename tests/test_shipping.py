"""The package reaches Python workers that don't have it on their path."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, os, sys
root = sys.argv[1]
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
sys.path.insert(0, root)
from klaxon.plans.queries import QUERIES
from klaxon.session import configure
configure(spark)
print("rows", QUERIES["debounce_alerts"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows " in done.stdout, done.stderr[-2000:]
