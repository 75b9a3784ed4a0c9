"""A result over a database that is read in the caller's session, where each session has a class path of its own on executors: its tasks, too, need the database's driver."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Spark runs a union in the session of its first frame. Eight reads go to all four executors, of which one has appended the rows.
RUN = """
import json, sys
from pyspark.sql import SparkSession
from millrace.plans import catalogue

sf, d, name = sys.argv[1:]
conf = {"spark.master": "local-cluster[4,1,1024]", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{d}/shared", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC",
        "spark.sql.artifact.isolation.enabled": "true", "spark.task.maxFailures": "1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
try:
    df = catalogue.queries()[name](spark, sf)
    read = spark.createDataFrame([], df.schema)
    for _ in range(8):
        read = read.union(df)
    out = [r.asDict() for r in read.collect()]
except Exception as e:
    out = str(e)[:2000]
with open(f"{d}/out.json", "w") as f:
    json.dump(out, f)
spark.stop()
"""


def test_table(tmp_path):
    subprocess.run([sys.executable, "-c", RUN, SF, str(tmp_path), "jdbc_table"], check=True, timeout=300, capture_output=True)
    got = json.loads((tmp_path / "out.json").read_text())
    assert isinstance(got, list), got
    con = duckdb.connect()
    con.sql(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    want = con.sql(catalogue.oracle_sql()["jdbc_table"])
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted((dict(zip(want.columns, r)) for r in want.fetchall() * 8), key=key)
