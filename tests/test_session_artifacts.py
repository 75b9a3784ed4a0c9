"""Queries over a database where each session has a class path of its own on executors: the database's driver must reach the engine's sessions."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: An application for the query alone: what other sessions ran would bring the driver to executors. One try a task, as others may land where it is.
RUN = """
import json, sys
from pyspark.sql import SparkSession
from millrace.plans import catalogue

sf, d, name = sys.argv[1:]
conf = {"spark.master": "local-cluster[4,1,1024]", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{d}/shared", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC",
        "spark.sql.artifact.isolation.enabled": "true", "spark.task.maxFailures": "1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
try:
    out = [r.asDict() for r in catalogue.queries()[name](spark, sf).collect()]
except Exception as e:
    out = str(e)[:2000]
with open(f"{d}/out.json", "w") as f:
    json.dump(out, f)
spark.stop()
"""


def same_as_duckdb(d, name):
    subprocess.run([sys.executable, "-c", RUN, SF, str(d), name], check=True, timeout=300, capture_output=True)
    got = json.loads((d / "out.json").read_text())
    assert isinstance(got, list), got
    con = duckdb.connect()
    con.sql(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted((dict(zip(want.columns, r)) for r in want.fetchall()), key=key)


def test_replace(tmp_path):
    same_as_duckdb(tmp_path, "jdbc_replace")


def test_slices(tmp_path):
    same_as_duckdb(tmp_path, "jdbc_slices")


def test_table(tmp_path):
    same_as_duckdb(tmp_path, "jdbc_table")
