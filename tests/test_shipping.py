"""Workers find the package without a search path of their own."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {warehouse!r}).getOrCreate()
from lexstrata import plans
for name in ("law_norms", "line_provenance", "schedule_next_run", "law_structure"):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
spark.stop()
"""


def test_queries_run_where_only_the_driver_has_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=str(Path(__file__).resolve().parents[1]), warehouse=str(tmp_path / "w"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
