"""The package must work when Python workers cannot import it: another folder, no PYTHONPATH."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("ROWS", entry.queries()["vector_clusters"](spark, sys.argv[2]).count(), entry.entry(spark).count())
"""


def test_clusters_from_another_folder(tmp_path, sf):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    out = subprocess.run([sys.executable, str(script), root, sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 500 450" in out.stdout, out.stdout + out.stderr[-3000:]
