"""Ready queries that go through sinks, archives, buffers and loops, each with its DuckDB query.

They write to a scratch folder of their own and return what is read back from it.
"""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..lang import ast as A
from ..runtime import Engine, Run
from ..sources.files import scratch
from ..streaming import drain, wal

NATION = [("n_nationkey", A.INT, True), ("n_name", A.STRING, True), ("n_regionkey", A.INT, False)]


def _engine(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    d = scratch(spark)
    return Engine(spark, Run(root=sf_dir, prefix={"out/": d + "/"})), d


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _engine(spark, sf_dir)
    return e.sql("LOAD INTO 'out/e.csv' AS SELECT event_id, user_id, event_type, value, NULLIF(event_type, 'click') AS maybe, props FROM 'events.parquet'; SELECT * FROM 'out/e.csv'")


def csv_dialect_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _engine(spark, sf_dir)
    return e.sql("LOAD INTO 'out/p.csv' WITH (delimiter = ';') AS SELECT p_partkey, p_name, p_size FROM 'part.parquet'; SELECT * FROM 'out/p.csv' WITH (delimiter = ';')")


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _engine(spark, sf_dir)
    return e.sql("LOAD INTO 'out/o.parquet' AS SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM 'orders.parquet'; SELECT o_orderkey, o_orderdate, CAST(price AS STRING) AS price FROM 'out/o.parquet'")


def csv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _engine(spark, sf_dir)
    load = "LOAD INTO 'out/n.csv' APPEND AS SELECT n_nationkey, n_name FROM 'nation.parquet';"
    return e.sql(f"{load} {load} SELECT n_nationkey, n_name FROM 'out/n.csv'")


def zip_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _engine(spark, sf_dir)
    e.run("LOAD INTO 'out/r.csv' AS SELECT r_regionkey, r_name FROM 'region.parquet'")
    with zipfile.ZipFile(f"{d}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.write(f"{d}/r.csv", "in/r.csv")
        z.writestr("other.csv", "x\n1\n")
    return e.sql("SELECT r_regionkey, r_name FROM 'out/a.zip :: in/r.csv'")


def for_each_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each event type, loaded side by side, and all of them read as one prefix."""
    e, d = _engine(spark, sf_dir)
    os.makedirs(f"{d}/types")
    e.run("FOR EACH ROW OF (SELECT DISTINCT event_type FROM 'events.parquet') AS (kind) PARALLEL LOAD INTO IDENTIFIER('out/types/' || $kind || '.csv') AS SELECT event_id, $kind AS kind, user_id FROM 'events.parquet' WHERE event_type = $kind; END FOR")
    return e.sql("SELECT kind, COUNT(*) AS n, SUM(user_id) AS s FROM 'out/types/' GROUP BY kind")


def discovered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _engine(spark, sf_dir)
    return e.sql("SELECT * FROM EACH TABLE OF (SELECT CASE range WHEN 0 THEN 'region.parquet' ELSE 'nation.parquet' END AS t, 'part' || range AS tag FROM RANGE(2)) AS (t, tag)")


def _segments(spark: SparkSession, sf_dir: str, d: str) -> wal.Buffer:
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows at any scale
    b = wal.Buffer(os.path.join(d, "wal", "nations"), segment_bytes=400)
    for i in range(0, len(rows), 4):
        b.append([json.loads(json.dumps(r)) for r in rows[i : i + 4]])
    b.rotate()
    return b


def buffer_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _engine(spark, sf_dir)
    _segments(spark, sf_dir, d)
    return e.sql("CREATE ENDPOINT '/n' ACCEPT BODY (n_nationkey INT NOT NULL, n_name STRING NOT NULL, n_regionkey INT) INTO BUFFER 'nations' AT 'out/wal'; SELECT n_regionkey, COUNT(*) AS n, MAX(n_name) AS last FROM BUFFER 'nations' AT 'out/wal' FLUSH EVERY 5 SECONDS OR 10 ROWS GROUP BY n_regionkey")


def buffer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments drained by Structured Streaming, each a batch that writes under its number; tried again, it overwrites itself."""
    d = scratch(spark)
    b = _segments(spark, sf_dir, d)
    q = drain.stream(spark, b.ready, NATION, f"{d}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{d}/loaded/batch={n}"), once=True)
    q.awaitTermination()
    return spark.read.parquet(f"{d}/loaded").select("n_nationkey", "n_name", "n_regionkey")


EXTRAS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "csv_roundtrip": (csv_roundtrip, "SELECT event_id, user_id, event_type, value, NULLIF(event_type, 'click') AS maybe, props FROM events"),
    "csv_dialect_roundtrip": (csv_dialect_roundtrip, "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part"),
    "parquet_roundtrip": (parquet_roundtrip, "SELECT o_orderkey, o_orderdate, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS VARCHAR) AS price FROM orders"),
    "csv_append": (csv_append, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation"),
    "zip_member": (zip_member, "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "for_each_prefix": (for_each_prefix, "SELECT event_type AS kind, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s FROM events GROUP BY 1"),
    "discovered_union": (discovered_union, "SELECT 'part0' AS tag, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 'part1', NULL, NULL FROM nation"),
    "buffer_replay": (buffer_replay, "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, COUNT(*) AS n, MAX(n_name) AS last FROM nation GROUP BY 1"),
    "buffer_stream": (buffer_stream, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
}
