"""Queries with Python functions run from a folder that does not hold the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF_DIR = "/root/testdata/sf0.001"

SCRIPT = f"""
import importlib.util, sys
from pyspark.sql import SparkSession

spec = importlib.util.spec_from_file_location("contract", "{ROOT}/__spark_entry__.py")
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
for name in ("gamma_fit", "ridge", "lasso_cv"):
    print("ROWS", name, contract.queries()[name](spark, "{SF_DIR}").count())
"""


def test_workers_load_the_package(tmp_path):
    if not Path(SF_DIR).exists():
        pytest.skip("driver tables are not here")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    rows = [x.split() for x in done.stdout.splitlines() if x.startswith("ROWS")]
    assert [(r[1], int(r[2]) > 0) for r in rows] == [("gamma_fit", True), ("ridge", True), ("lasso_cv", True)], done.stderr[-2000:]
