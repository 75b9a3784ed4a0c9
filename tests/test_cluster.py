"""Queries over a database on a cluster: executors are JVMs of their own, which see nothing of the driver's memory."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["jdbc_pushdown", "jdbc_raw_query", "jdbc_replace", "jdbc_slices", "jdbc_table"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
RUN = """
import json, sys
from pyspark.sql import SparkSession
from millrace.plans import catalogue

sf, shared, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{shared}", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
out = {}
for name in names:
    try:
        out[name] = [r.asDict() for r in catalogue.queries()[name](spark, sf).collect()]
    except Exception as e:
        out[name] = str(e)[:2000]
with open(f"{shared}/out.json", "w") as f:
    json.dump(out, f)
spark.stop()
"""


@pytest.fixture(scope="module")
def on_cluster(tmp_path_factory):
    d = tmp_path_factory.mktemp("shared")
    subprocess.run([sys.executable, "-c", RUN, SF, str(d), *NAMES], check=True, timeout=300, capture_output=True)
    return json.loads((d / "out.json").read_text())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_duckdb_on_a_cluster(on_cluster, name):
    assert isinstance(on_cluster[name], list), on_cluster[name]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    key = lambda r: repr(sorted(r.items()))
    assert sorted(on_cluster[name], key=key) == sorted((dict(zip(want.columns, r)) for r in want.fetchall()), key=key)
