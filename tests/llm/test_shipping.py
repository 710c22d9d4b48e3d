"""The numbered queries reach Python workers that don't have the package on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
OTHER_FOLDER = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
sys.path.insert(0, sys.argv[1])
import __spark_entry__
print("rows", __spark_entry__.queries()["op4_bpe_round_trip"](spark, "/root/testdata/sf0.001").count())
"""
HIDDEN = """
import sys
sys.modules["tokenizers"] = sys.modules["public_tokenizers"] = None
sys.path.insert(0, sys.argv[1])
import __spark_entry__
names = __spark_entry__.queries()
print("core", len(names), sum(n.startswith("op") for n in names), "match_alerts" in names)
"""


def output(script, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script, ROOT], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    return done.stdout or done.stderr[-2000:]


def test_first_query_from_another_folder(tmp_path):
    assert "rows " in output(OTHER_FOLDER, tmp_path)


def test_without_a_tokenizer(tmp_path):
    said = output(HIDDEN, tmp_path)
    assert said.startswith("core 6") and said.split()[2:] == ["0", "True"], said
