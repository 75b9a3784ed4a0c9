import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def engine(spark, tmp_path):
    from millrace.runtime import Engine, Run

    def make(**run):
        return Engine(spark, Run(root=str(tmp_path), log=run.pop("log", lambda s: None), **run))

    return make


@pytest.fixture
def rows(engine, tmp_path):
    """Runs a script and gives the last SELECT's rows as tuples."""

    def run(script, **kw):
        return [tuple(r) for r in engine(**kw).sql(script).collect()]

    run.root = tmp_path
    return run
