"""Queries over a database where executors start after temp folders were cleared: what executors fetch from the driver must still be there."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: The first query is run before, the others after the temp folder has gone and all executors have been replaced.
RUN = """
import json, os, sys, tempfile, time
import psutil
from pyspark.sql import SparkSession
from millrace.plans import catalogue

sf, d, first, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{d}/shared", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()

def executors():
    return {p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())}

def run(name):
    try:
        return [r.asDict() for r in catalogue.queries()[name](spark, sf).collect()]
    except Exception as e:
        return str(e)[:2000]

os.mkdir(f"{d}/tmp")
tempfile.tempdir = f"{d}/tmp"
out = {first: run(first)}
os.rename(f"{d}/tmp", f"{d}/cleared")
os.mkdir(f"{d}/tmp")
old = executors()
assert len(old) == 2, old
for p in old:
    p.kill()
psutil.wait_procs(old, timeout=30)
until = time.time() + 60
while len(executors() - old) < 2:
    assert time.time() < until, "no new executors"
    time.sleep(0.5)
out |= {name: run(name) for name in names}
with open(f"{d}/out.json", "w") as f:
    json.dump(out, f)
spark.stop()
"""


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    d = tmp_path_factory.mktemp("late")
    subprocess.run([sys.executable, "-c", RUN, SF, str(d), "jdbc_pushdown", "jdbc_raw_query", "jdbc_replace", "jdbc_slices", "jdbc_table"], check=True, timeout=300, capture_output=True)
    return json.loads((d / "out.json").read_text())


def same_as_duckdb(late, name):
    assert isinstance(late[name], list), late[name]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    key = lambda r: repr(sorted(r.items()))
    assert sorted(late[name], key=key) == sorted((dict(zip(want.columns, r)) for r in want.fetchall()), key=key)


def test_raw_query(late):
    same_as_duckdb(late, "jdbc_raw_query")


def test_replace(late):
    same_as_duckdb(late, "jdbc_replace")


def test_slices(late):
    same_as_duckdb(late, "jdbc_slices")


def test_table(late):
    same_as_duckdb(late, "jdbc_table")
