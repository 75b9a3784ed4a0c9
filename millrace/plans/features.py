"""Ready queries for what a plain SELECT over the tables does not reach, each with its DuckDB query.

Files are written to a scratch folder, services are small servers of the driver that answer from the tables, and what is
to be refused comes back as a row that says so.
"""

from __future__ import annotations

import contextlib
import datetime
import gzip
import http.server
import io
import json
import os
import tempfile
import threading
import urllib.request
import zipfile
from collections.abc import Callable
from functools import cache
from urllib.parse import parse_qs, urlsplit

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from ..errors import PlanError, RunError, Thrown
from ..lang import ast as A
from ..runtime import Engine, Run, exit_code, show
from ..sinks import sql as sql_sinks
from ..sources import files, jdbc
from ..sources.files import scratch
from ..streaming import wal
from ..streaming.serve import Host

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f, oracle
        return f

    return add


def _engine(spark: SparkSession, sf_dir: str, **run) -> tuple[Engine, str]:
    d = scratch(spark)
    return Engine(spark, Run(root=sf_dir, prefix={"out/": d + "/"}, **{"log": lambda s: None, **run})), d


def _values(columns: str, *rows: tuple) -> str:
    """A DuckDB query of constant rows; whole numbers are BIGINT."""
    cell = lambda v: f"CAST({v} AS BIGINT)" if type(v) is int else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def _nations(sf_dir: str, spark: SparkSession) -> list[dict]:
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows at any scale


NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


# -- files
@_query("SELECT 'gz' AS codec, event_id, event_type FROM events UNION ALL SELECT 'zst', event_id, event_type FROM events")
def csv_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import zstandard

    e, d = _engine(spark, sf_dir)
    e.run("LOAD INTO 'out/e.csv' AS SELECT event_id, event_type FROM 'events.parquet'")
    with open(f"{d}/e.csv", "rb") as f, gzip.open(f"{d}/a.csv.gz", "wb") as g, open(f"{d}/b.csv.zst", "wb") as z:
        with zstandard.ZstdCompressor().stream_writer(z, closefd=False) as packed:
            while chunk := f.read(1 << 20):
                g.write(chunk)
                packed.write(chunk)
    return e.sql("SELECT 'gz' AS codec, event_id, event_type FROM 'out/a.csv.gz' UNION ALL BY NAME SELECT 'zst' AS codec, event_id, event_type FROM 'out/b.csv.zst'")


CODECS = ("none", "gzip", "zstd", "snappy", "lz4")


@_query("SELECT c.codec, event_type, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s, MAX(ts) AS t FROM events CROSS JOIN (VALUES ('none'), ('gzip'), ('zstd'), ('snappy'), ('lz4')) c(codec) GROUP BY 1, 2")
def parquet_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _engine(spark, sf_dir)
    for c in CODECS:
        spark.read.parquet(f"{sf_dir}/events.parquet").write.option("compression", c).parquet(f"{d}/{c}.parquet")
    return e.sql(" UNION ALL BY NAME ".join(f"SELECT '{c}' AS codec, event_type, COUNT(*) AS n, SUM(user_id) AS s, MAX(ts) AS t FROM 'out/{c}.parquet' GROUP BY event_type" for c in CODECS))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name || ' éüß' AS t, e AS enc FROM nation CROSS JOIN (VALUES ('latin1'), ('cp1252')) x(e)")
def csv_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _engine(spark, sf_dir)
    for enc in ("latin1", "cp1252"):
        with open(f"{d}/{enc}.csv", "w", encoding=enc) as f:
            f.write("k;t\n" + "".join(f"{r['n_nationkey']};{r['n_name']} éüß\n" for r in _nations(sf_dir, spark)))
    return e.sql(" UNION ALL BY NAME ".join(f"SELECT k, t, '{enc}' AS enc FROM 'out/{enc}.csv' WITH (delimiter = ';', encoding = '{enc}')" for enc in ("latin1", "cp1252")))


@_query(NATION)
def format_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _engine(spark, sf_dir)
    e.run("LOAD INTO 'out/n.csv' WITH (delimiter = tab) AS SELECT * FROM 'nation.parquet'")
    os.rename(f"{d}/n.csv", f"{d}/n.dat")
    return e.sql("SELECT * FROM 'out/n.dat' WITH (format = 'csv', delimiter = tab)")


@_query("SELECT CAST(r_regionkey + 1 AS BIGINT) AS k, r_name FROM region")
def buffered_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _engine(spark, sf_dir)
    return e.sql("LOAD INTO 'out/r.csv' AS SELECT r_regionkey AS k, r_name FROM 'region.parquet'; LOAD INTO 'out/r.csv' REPLACE AS SELECT k + 1 AS k, r_name FROM 'out/r.csv' WITH (buffer); SELECT * FROM 'out/r.csv'")


@_query(_values("x, n", ("b", 2), ("b", 2), ("c", 3)))
def sink_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _engine(spark, sf_dir)
    return e.sql("""LOAD INTO 'out/a.csv' AS SELECT 'a' AS x, 1 AS n; LOAD INTO 'out/a.csv' REPLACE AS SELECT 'b' AS x, 2 AS n; LOAD INTO 'out/a.csv' APPEND AS SELECT 'b' AS x, 2 AS n;
        LOAD INTO 'out/a.csv' APPEND AS SELECT 'c' AS x, 3 AS n; SELECT * FROM 'out/a.csv'""")


@_query("SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1")
def split_by_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _engine(spark, sf_dir)
    return e.sql("LOAD INTO 'out/s.parquet' SPLIT BY (user_id) JOBS 3 AS SELECT user_id, event_id FROM 'events.parquet'; SELECT user_id, COUNT(*) AS n FROM 'out/s.parquet' GROUP BY user_id")


@_query("SELECT user_id, MIN(event_id) AS event_id FROM events GROUP BY 1")
def distinct_on_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of unequal size: the first row of a key is the first in the order of their names, not of how Spark packs them."""
    e, d = _engine(spark, sf_dir)
    os.makedirs(f"{d}/many")
    n = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("max(event_id)").first()[0] + 1
    for i, (a, b) in enumerate(((0, 0.05), (0.05, 0.1), (0.1, 0.7), (0.7, 1.1))):
        e.run(f"LOAD INTO 'out/many/p{i}.csv' AS SELECT user_id, event_id FROM 'events.parquet' WHERE event_id >= {int(a * n)} AND event_id < {int(b * n)} ORDER BY event_id")
    return e.sql("SELECT DISTINCT ON (user_id) user_id, event_id FROM 'out/many/'")


@_query("SELECT COUNT(*) AS n, MIN(event_id) AS lo, MAX(event_id) AS hi, MAX(value) AS v, COUNT(user_id) AS u FROM events")
def agg_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir)[0].sql("SELECT COUNT(*) AS n, MIN(event_id) AS lo, MAX(event_id) AS hi, MAX(value) AS v, COUNT(user_id) AS u FROM 'events.parquet'")


# -- names, joins, windows, unions
@_query('SELECT event_type AS "Kind of Event", COUNT(*) AS "how many?" FROM events GROUP BY 1')
def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir)[0].sql("""SELECT "Kind of Event", COUNT(*) AS "how many?" FROM (SELECT event_type AS "Kind of Event" FROM 'events.parquet') t GROUP BY "Kind of Event" """)


@_query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_max_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir)[0].sql("WITH c AS (SELECT c_custkey, c_name FROM 'customer.parquet' WITH (max_build = '16GB')) SELECT o_orderkey, c_name FROM 'orders.parquet' JOIN c ON o_custkey = c_custkey")


@_query("SELECT event_id, 'up' AS way, ROW_NUMBER() OVER (PARTITION BY user_id % 5 ORDER BY NULLIF(event_type, 'click') NULLS LAST, event_id) AS r FROM events UNION ALL SELECT event_id, 'down', ROW_NUMBER() OVER (PARTITION BY user_id % 5 ORDER BY NULLIF(event_type, 'click') DESC NULLS LAST, event_id) FROM events")
def win_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = "SELECT event_id, '{}' AS way, ROW_NUMBER() OVER (PARTITION BY g ORDER BY k{}, event_id) AS r FROM (SELECT event_id, user_id % 5 AS g, NULLIF(event_type, 'click') AS k FROM 'events.parquet') t"
    return _engine(spark, sf_dir)[0].sql(branch.format("up", "") + " UNION ALL BY NAME " + branch.format("down", " DESC"))


@_query("SELECT 'a' AS tag, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 'b', n_regionkey, NULL FROM nation")
def union_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir)[0].sql("SELECT 'a' AS tag, r_name, r_regionkey FROM 'region.parquet' UNION ALL BY NAME SELECT 'b' AS tag, n_regionkey AS r_regionkey FROM 'nation.parquet' ANCHOR SCHEMA 'region.parquet'")


@_query("SELECT 'a' AS tag, CAST(r_regionkey AS BIGINT) AS k FROM region UNION ALL SELECT 'b', n_nationkey FROM nation")
def union_one_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir)[0].sql("LOAD INTO 'out/u.csv' AS SELECT 'a' AS tag, r_regionkey AS k FROM 'region.parquet' UNION ALL BY NAME SELECT 'b' AS tag, n_nationkey AS k FROM 'nation.parquet'; SELECT * FROM 'out/u.csv'")


# -- functions and casts
@_query("SELECT true AS same_day, true AS past")
def fn_now_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir)[0].sql("SELECT date_diff('day', today(), now()) = 0 AS same_day, now() > '2024-01-01' AS past")


@_query("SELECT p_partkey, strlen(p_name || 'é') AS b, strlen(p_name || 'é') AS l FROM part")
def fn_strlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir)[0].sql("SELECT p_partkey, strlen(p_name || 'é') AS b, length(p_name || 'é') AS l FROM 'part.parquet'")


@_query("SELECT event_id, ts AS t, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d, CAST(NULL AS TIMESTAMP) AS bad FROM events")
def cast_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir)[0].sql("SELECT event_id, CAST(CAST(ts AS STRING) AS TIMESTAMP) AS t, CAST(substr(CAST(ts AS STRING), 1, 10) AS TIMESTAMP) AS d, TRY_CAST(event_type AS TIMESTAMP) AS bad FROM 'events.parquet'")


# -- what is refused
REFUSED = {
    "join key types": "WITH b AS (SELECT r_name FROM 'region.parquet') SELECT event_id FROM 'events.parquet' a JOIN b ON a.event_id = b.r_name",
    "bare column": "SELECT event_type, user_id, COUNT(*) AS n FROM 'events.parquet' GROUP BY event_type",
    "window in where": "SELECT event_id FROM 'events.parquet' WHERE ROW_NUMBER() OVER (ORDER BY event_id) = 1",
    "rank with a frame": "SELECT RANK() OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r FROM 'events.parquet'",
    "unknown column": "SELECT nothing FROM 'events.parquet'",
    "unknown file": "SELECT * FROM 'nothing.parquet'",
    "unknown function": "SELECT nothing(event_id) AS x FROM 'events.parquet'",
    "column twice": "SELECT event_id, event_id FROM 'events.parquet'",
    "parquet codec": "SELECT * FROM 'x.parquet.gz'",
    "append to parquet": "LOAD INTO 'x.parquet' APPEND AS SELECT 1 AS a",
    "upsert to a file": "LOAD INTO 'x.csv' UPSERT ON (a) AS SELECT 1 AS a",
    "size of max_build": "SELECT * FROM 'region.parquet' WITH (max_build = 'much')",
    "missing parameter": "PARAM n INT; SELECT $n AS n",
    "recursion": "CREATE FUNCTION f(a) AS f(a); SELECT f(1) AS x",
    "branch types": "SELECT event_id AS x FROM 'events.parquet' UNION ALL BY NAME SELECT event_type AS x FROM 'events.parquet'",
    "order by": "SELECT event_id FROM 'events.parquet' ORDER BY nothing",
}


@_query(_values("what, refused", *((k, True) for k in REFUSED)))
def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before a row is read."""
    def fails(script: str) -> bool:
        try:
            _engine(spark, sf_dir)[0].check(script)
        except PlanError:
            return True
        return False

    return spark.createDataFrame([(k, fails(s)) for k, s in REFUSED.items()], "what string, refused boolean")


# -- scripts
@_query("SELECT 'small' AS size, event_type, COUNT(*) AS n FROM events WHERE user_id < 10 GROUP BY ALL UNION ALL SELECT 'big', event_type, COUNT(*) FROM events WHERE user_id < 100 GROUP BY ALL")
def call_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement function with a default, called twice; each writes a file of its own."""
    e, _ = _engine(spark, sf_dir)
    e.run("""CREATE FUNCTION part(name, most DEFAULT 10) AS
          LOAD INTO IDENTIFIER('out/c_' || $name || '.csv') AS SELECT $name AS size, event_type, COUNT(*) AS n FROM 'events.parquet' WHERE user_id < $most GROUP BY event_type;
        END; CALL part('small'); CALL part('big', 100)""")
    return e.sql("SELECT * FROM 'out/c_small.csv' UNION ALL BY NAME SELECT * FROM 'out/c_big.csv'")


@_query("SELECT 'dev' AS env, COUNT(*) AS n FROM region UNION ALL SELECT 'prod', COUNT(*) FROM nation UNION ALL SELECT 'staging', COUNT(*) FROM nation")
def case_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = "PARAM env STRING DEFAULT 'dev'; CASE $env WHEN 'prod', 'staging' THEN SELECT $env AS env, COUNT(*) AS n FROM 'nation.parquet'; ELSE SELECT $env AS env, COUNT(*) AS n FROM 'region.parquet'; END CASE"
    parts = [_engine(spark, sf_dir, params={"env": x})[0].sql(script) for x in ("dev", "prod", "staging")]
    return parts[0].union(parts[1]).union(parts[2])


@_query("SELECT event_id, value * 2 + 1 AS v FROM events")
def include(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _engine(spark, sf_dir)
    os.makedirs(f"{d}/lib")
    for name, text in (("lib/a.sql", "@include 'b.sql'; CREATE FUNCTION odd(x) AS twice(x) + 1;"), ("lib/b.sql", "CREATE FUNCTION twice(x) AS x * 2;")):
        with open(f"{d}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    return e.run("@include 'lib/a.sql'; SELECT event_id, odd(value) AS v FROM 'events.parquet'", f"{d}/main.sql")[0].df


@_query(_values("said", ("loading a",), ("1.5 and 7",), ("stopped: too few",)))
def print_and_throw(spark: SparkSession, sf_dir: str) -> DataFrame:
    said: list[str] = []
    e, _ = _engine(spark, sf_dir, log=said.append)
    try:
        e.run("PRINT 'loading ' || 'a'; PRINT 1.5 || ' and ' || 7; THROW 'never' WHEN 1 > 2; THROW 'too few' WHEN 2 > 1; PRINT 'not reached'")
    except Thrown as x:
        said.append(f"stopped: {x.message}")
    return spark.createDataFrame([(s,) for s in said], "said string")


@_query(_values("sql", ("SELECT a, b FROM x_t WHERE c = 2",)))
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _engine(spark, sf_dir)[0].template("SELECT ${cols} FROM ${lower(name) || '_t'} WHERE c = ${ 1 + 1 }", {"cols": A.Lit("a, b", A.STRING), "name": A.Lit("X", A.STRING)})
    return spark.createDataFrame([(made,)], "sql string")


@_query(_values("form, planned, ran, written", ("EXPLAIN", True, False, False), ("EXPLAIN ANALYZE", True, True, False)))
def explain_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms show the plan; ANALYZE runs into a sink that discards; neither writes."""
    e, d = _engine(spark, sf_dir)
    out = []
    for form in ("EXPLAIN", "EXPLAIN ANALYZE"):
        text = e.run(f"{form} LOAD INTO 'out/x.csv' AS SELECT event_type, SUM(user_id) AS s FROM 'events.parquet' GROUP BY event_type")[0].text
        out.append((form, "HashAggregate" in text and "event_type STRING, s INT" in text, "ran in" in text, os.path.exists(f"{d}/x.csv")))
    return spark.createDataFrame(out, "form string, planned boolean, ran boolean, written boolean")


@_query(NATION)
def stdout_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a terminal SELECT prints as NDJSON, read again."""
    r = _engine(spark, sf_dir)[0].run("SELECT * FROM 'nation.parquet' ORDER BY n_nationkey")[-1]
    return spark.createDataFrame([tuple(json.loads(line).values()) for line in show(r, "json")], "n_nationkey long, n_name string, n_regionkey long")


@_query(_values("call, code, said", ("run", 0, '{"a":1}'), ("check", 1, ""), ("params", 0, '{"n":7}')))
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..cli import main
    from ..session import SETTINGS

    out = []
    # The command line makes the session its own; the caller's settings are put back.
    keys = [*SETTINGS, "spark.sql.shuffle.partitions"]
    sessions = [x for x in (spark, SparkSession.getActiveSession()) if x is not None]
    before = [{k: x.conf.get(k, None) for k in keys} for x in sessions]
    for name, args in (("run", ["run", "-c", "SELECT 1 AS a", "--format", "json"]), ("check", ["check", "-c", "SELECT zz AS a"]), ("params", ["run", "-c", "PARAM n INT; SELECT $n AS n", "-p", "n=7", "--format", "json"])):
        said = io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(io.StringIO()):
            code = main(args)
        out.append((name, code, json.dumps(json.loads(said.getvalue()), separators=(",", ":")) if code == 0 else ""))
    for x, old in zip(sessions, before, strict=True):
        for k, v in old.items():
            x.conf.set(k, v) if v is not None else x.conf.unset(k)
    return spark.createDataFrame(out, "call string, code long, said string")


@_query(_values("error, code", ("transient", 75), ("plan", 1), ("interrupt", 130), ("none", 0)))
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = {"transient": RunError("x", transient=True), "plan": PlanError("x"), "interrupt": KeyboardInterrupt(), "none": None}
    return spark.createDataFrame([(k, exit_code(e)) for k, e in errors.items()], "error string, code long")


# -- services
class _Api(http.server.BaseHTTPRequestHandler):
    """Answers with a table's rows, paged; has busy and closed addresses, a login and files; takes Stream Loads."""

    busy: dict[str, int] = {}
    loads: list[tuple[str, str]] = []

    def do_GET(self) -> None:
        parts = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(parts.query).items()}
        _, kind, *rest = parts.path.split("/")
        if kind == "file":
            with open("/" + "/".join(rest), "rb") as f:
                return self.answer(f.read())
        if kind == "busy" and _Api.busy.get(rest[0]):
            _Api.busy[rest[0]] -= 1
            return self.answer(b"", 503)
        if kind == "closed" and self.headers.get("Authorization") not in ("Bearer tok", "Basic dTpw", "Bearer given"):
            return self.answer(b"", 401)
        rows = self.server.rows
        size = int(q.get("per_page", q.get("limit", 7)))
        start = int(q.get("cursor", q.get("offset", (int(q.get("page", 1)) - 1) * size)))
        return self.answer(json.dumps({"meta": {"total": len(rows)}, "data": rows[start : start + size], "next": str(start + size) if start + size < len(rows) else None}).encode())

    def do_POST(self) -> None:
        self.rfile.read(int(self.headers.get("Content-Length") or 0))
        self.answer(json.dumps({"access_token": "given", "token": "given"}).encode())

    def do_PUT(self) -> None:
        _Api.loads.append((self.headers["label"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
        self.answer(b'{"Status": "Success"}')

    def answer(self, body: bytes, code: int = 200) -> None:
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a) -> None:
        pass


@cache
def _server(rows: str) -> str:
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Api)
    s.rows = json.loads(rows)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{s.server_port}"


def _api(spark: SparkSession, sf_dir: str) -> str:
    return _server(json.dumps(_nations(sf_dir, spark)))


@_query(f"SELECT 'csv' AS kind, * FROM ({NATION}) UNION ALL SELECT 'parquet', * FROM ({NATION})")
def http_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _engine(spark, sf_dir)
    e.run("LOAD INTO 'out/n.csv' AS SELECT * FROM 'nation.parquet'; LOAD INTO 'out/n.parquet' AS SELECT * FROM 'nation.parquet'")
    at = f"{_api(spark, sf_dir)}/file{d}"
    return e.sql(" UNION ALL BY NAME ".join(f"SELECT '{k}' AS kind, t.* FROM '{at}/n.{k}' t" for k in ("csv", "parquet")))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey < 7")
def rest_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir)[0].sql(f"SELECT n_nationkey, n_name FROM HTTP('{_api(spark, sf_dir)}/x') WITH (items = 'data')")


PAGINATION = {
    "page with total": "PAGINATE BY page (size = 4, total = 'meta.total')",
    "page": "PAGINATE BY page (size = 4)",
    "offset": "PAGINATE BY offset (size = 6)",
    "cursor": "PAGINATE BY cursor (field = 'next', size = 4)",
    "exact pages": "PAGINATE BY page (size = 5)",
    "ahead": "PAGINATE BY page (size = 4, prefetch = 3)",
    "ahead, exact pages": "PAGINATE BY offset (size = 5, prefetch = 4)",
}


@_query(f"SELECT how, n_nationkey, n_name FROM ({NATION}) CROSS JOIN ({_values('how', *((k,) for k in PAGINATION))})")
def rest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = _engine(spark, sf_dir)[0], _api(spark, sf_dir)
    return e.sql(" UNION ALL BY NAME ".join(f"SELECT '{k}' AS how, n_nationkey, n_name FROM HTTP('{at}/x') {clause} WITH (items = 'data')" for k, clause in PAGINATION.items()))


@_query(_values("auth, n", ("bearer", 14), ("basic", 7), ("none", -1)))
def rest_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections by several ways to be let in, and one without."""
    at, out = _api(spark, sf_dir), []
    for auth, options, clause in (("bearer", "auth = 'bearer', token = 'tok'", "PAGINATE BY page (size = 7, max = 2) "), ("basic", "auth = 'basic', user = 'u', password = 'p'", ""), ("none", "auth = 'none'", "")):
        try:
            n = _engine(spark, sf_dir)[0].sql(f"CREATE CONNECTION crm TYPE http OPTIONS (base_url = '{at}', {options}); SELECT COUNT(*) AS n FROM crm.'/closed/x' {clause}WITH (items = 'data')").first()[0]
        except RunError:
            n = -1
        out.append((auth, n))
    return spark.createDataFrame(out, "auth string, n long")


@_query(_values("what, n", ("tried again", 7), ("given up", -1)))
def rest_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at, out = _engine(spark, sf_dir)[0], _api(spark, sf_dir), []
    for what, times in (("tried again", 3), ("given up", 1)):
        name = what.replace(" ", "")
        _Api.busy[name] = 2
        try:
            n = e.sql(f"SELECT COUNT(*) AS n FROM HTTP('{at}/busy/{name}') RETRY {times} ON (503) WITH (items = 'data', timeout_ms = 5000)").first()[0]
        except RunError:
            n = -1
        out.append((what, n))
    return spark.createDataFrame(out, "what string, n long")


@_query("SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, COUNT(*) AS n, MIN(n_name) AS first FROM nation GROUP BY 1")
def request_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _engine(spark, sf_dir, request_body=_nations(sf_dir, spark))
    return e.sql("SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS first FROM BODY (n_regionkey INT NOT NULL, n_name STRING) GROUP BY n_regionkey")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS nothing FROM nation")
def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a Stream Load endpoint was sent, under the labels of one run."""
    e, d = _engine(spark, sf_dir)
    e.run_.label = "run" + "".join(c for c in os.path.basename(d) if c.isalnum())
    e.run(f"CREATE CONNECTION sr TYPE starrocks OPTIONS (be_url = '{_api(spark, sf_dir)}', database = 'd', auto_create = false); LOAD INTO sr.t USING stream_load WITH (auto_create = false) AS SELECT n_nationkey, n_name, NULLIF('x', 'x') AS nothing FROM 'nation.parquet'")
    sent = [line.split("\t") for label, body in _Api.loads if label.startswith(e.run_.label) for line in body.splitlines()]
    return spark.createDataFrame([(int(k), n, None if x == "\\N" else x) for k, n, x in sent], "n_nationkey long, n_name string, nothing string")


@_query(_values("call, code, n", ("in", 200, 25), ("sum", 200, 300), ("bad", 422, 0), ("gone", 404, 0), ("loaded", 200, 25)))
def http_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTTP host: rows into a buffer, a direct answer, a refused row, an unknown path, and the buffer drained to a file."""
    d, rows = scratch(spark), _nations(sf_dir, spark)
    scripts = {
        "in": "CREATE ENDPOINT '/in' ACCEPT BODY (n_nationkey INT NOT NULL, n_name STRING NOT NULL) INTO BUFFER 'q' AT 'wal' SEGMENT 1 MB MAX 1 GB RETAIN UNTIL LOADED; LOAD INTO 'loaded.csv' APPEND AS SELECT n_nationkey, n_name FROM BUFFER 'q' AT 'wal' FLUSH EVERY 1 SECONDS OR 2 ROWS;",
        "sum": "CREATE ENDPOINT '/sum'; SELECT SUM(n_nationkey) AS s FROM BODY (n_nationkey INT NOT NULL);",
    }
    for name, text in scripts.items():
        with open(f"{d}/{name}.sql", "w", encoding="utf-8") as f:
            f.write(text)
    h = Host(spark, d, Run(root=d, log=lambda s: None))
    server = h.server("127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path: str, doc: object) -> tuple[int, dict]:
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(doc).encode()) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, {}

    taken, answered, bad, gone = call("/in", rows), call("/sum", rows), call("/in", {"n_name": "x"}), call("/zz", {})
    route = h.routes["/in"]
    route.buffer.rotate()
    h.drain(route)
    server.shutdown()
    with open(f"{d}/loaded.csv", encoding="utf-8") as f:
        loaded = len(f.readlines()) - 1
    out = [("in", taken[0], taken[1].get("accepted", 0)), ("sum", answered[0], answered[1]["rows"][0]["s"]), ("bad", bad[0], 0), ("gone", gone[0], 0), ("loaded", 200, loaded)]
    return spark.createDataFrame(out, "call string, code long, n long")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def wal_after_a_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose last record was cut off: all rows before it are there again, and none of it."""
    d, rows = scratch(spark), _nations(sf_dir, spark)
    b = wal.Buffer(f"{d}/q", segment_bytes=300)
    for r in rows:
        b.append([{"n_nationkey": r["n_nationkey"], "n_name": r["n_name"]}])
    b.append([{"n_nationkey": 98, "n_name": "cut"}])
    last = max((p for p in os.listdir(f"{d}/q") if p.startswith("open-")), key=lambda p: os.path.getmtime(f"{d}/q/{p}"))
    with open(f"{d}/q/{last}", "rb+") as f:
        f.truncate(os.path.getsize(f"{d}/q/{last}") - 4)
    again = wal.Buffer(f"{d}/q", segment_bytes=300)
    again.rotate()
    found = [json.loads(line) for s in again.pending() for line in open(again.path(s), encoding="utf-8")]
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in found], "n_nationkey long, n_name string")


# -- texts for stores and servers that are not at hand
@_query(_values(
    "what, said", ("az", "abfss://box@acct.dfs.core.windows.net/a/b.csv"), ("s3", "s3a://b/k.parquet"), ("postgres", "jdbc:postgresql://h:5432/d"), ("mysql", "jdbc:mysql://h:3306/d"),
    ("table", 'SELECT * FROM "s"."t" WHERE a > 1'), ("raw", "SELECT 1"), ("int slices", '"id" < 50 OR "id" IS NULL; "id" >= 50'),
    ("date slices", "\"d\" < '2024-01-06' OR \"d\" IS NULL; \"d\" >= '2024-01-06'"), ("uuid slices", "\"u\" < '80000000-0000-0000-0000-000000000000' OR \"u\" IS NULL; \"u\" >= '80000000-0000-0000-0000-000000000000'"),
    ("create", "CREATE TABLE IF NOT EXISTS `t` (`k` VARCHAR(255) NOT NULL, `v` DECIMAL(10,2), PRIMARY KEY (`k`))"), ("upsert postgres", "true"), ("upsert mysql", "true"), ("upsert sqlserver", "true"),
))
def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, queries, slices of keys and upserts as they are sent; no server is here to run them."""
    pg, my, ms = (jdbc.Connection("c", t, {"host": "h", "database": "d", "user": "u", "password": "p"}) for t in ("postgres", "mysql", "sqlserver"))
    upsert = lambda c, sign: str(sign in sql_sinks.upsert_statement(c, None, "t", "s", ["k", "v"], ["k"])).lower()
    out = {
        "az": files.located("az://acct/box/a/b.csv"), "s3": files.located("s3://b/k.parquet"), "postgres": pg.url(), "mysql": my.url(),
        "table": jdbc.query_of(pg, "s", "t", None, "a > 1"), "raw": jdbc.query_of(my, None, None, "SELECT 1", None), "int slices": "; ".join(jdbc.slices("id", 0, 99, 2, "postgres")),
        "date slices": "; ".join(jdbc.date_slices("d", datetime.date(2024, 1, 1), datetime.date(2024, 1, 10), 2, "postgres")), "uuid slices": "; ".join(jdbc.uuid_slices("u", 2, "postgres")),
        "create": sql_sinks.create_statement(my, None, "t", {"k": A.STRING, "v": A.Type("decimal", 10, 2)}, ["k"]),
        "upsert postgres": upsert(pg, 'ON CONFLICT ("k") DO UPDATE SET'), "upsert mysql": upsert(my, "ON DUPLICATE KEY UPDATE"), "upsert sqlserver": upsert(ms, "MERGE"),
    }
    return spark.createDataFrame(list(out.items()), "what string, said string")


# -- a database: the embedded one that Spark brings along, spoken to as the dialect that quotes alike
DERBY, FAR = "org.apache.derby.iapi.jdbc.AutoloadedDriver", "millrace.FarDriver"


@cache
def _far(sc: SparkContext) -> tuple[str, str, str]:
    """Where executors reach the in-memory databases of the driver's JVM: host and port, and a token. Their driver is compiled here and sent to them; its jar comes third."""
    jvm, conf = sc._jvm, sc.getConf()
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    # An executor that starts later asks for it again, and can run nothing without it: it lies with the application's own files, not where temp folders are cleared.
    jar = os.path.join(sc._temp_dir, "far-driver.jar")
    if not os.path.exists(jar):
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        with open(os.path.join(os.path.dirname(__file__), "FarDriver.java"), encoding="utf-8") as f:
            compiler.cook(f.read())
        fd, part = tempfile.mkstemp(dir=sc._temp_dir)
        with open(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        os.replace(part, jar)
    loader.addURL(jvm.java.io.File(jar).toURI().toURL())
    sc._jsc.addJar(jar)
    host = conf.get("spark.driver.host")
    port, token = jvm.millrace.FarDriver.serve(conf.get("spark.driver.bindAddress", host)).split("/")
    return f"{host}:{port}", token, jar


def _sent(e: Engine, *readers: SparkSession) -> Engine:
    """Where each session has a class path of its own on executors, tasks of a session lack what the application has added: the engine's and those that read its results get the database's driver themselves."""
    for s in (e.spark, *readers):
        if s.conf.get("spark.sql.artifact.isolation.enabled", "false") == "true":
            s._jsparkSession.addArtifact(_far(s.sparkContext)[2])
    return e


def _database(spark: SparkSession, sf_dir: str) -> tuple[Engine, str, jdbc.Connection]:
    """An engine, the script that connects to an in-memory database with an empty table ``nation``, and the driver's own connection to it."""
    e, d = _engine(spark, sf_dir)
    name = os.path.basename(d)
    at, token, _ = _far(spark.sparkContext)
    c = jdbc.Connection("pg", "postgres", {"url": f"jdbc:derby:memory:{name};create=true", "driver": DERBY})
    sql_sinks.execute(spark.range(1), c, 'CREATE TABLE "nation" ("n_nationkey" BIGINT NOT NULL, "n_name" VARCHAR(40), "n_regionkey" BIGINT, "day" DATE)')
    return _sent(e, spark), f"CREATE CONNECTION pg TYPE postgres OPTIONS (url = 'jdbc:derby://{at}/{name};token={token}', driver = '{FAR}', auto_split = false); ", c


LOAD_NATION = "LOAD INTO pg.nation APPEND WITH (auto_create = false) AS SELECT n_nationkey, n_name, n_regionkey, date_add('day', n_nationkey, make_date(2024, 1, 1)) AS day FROM 'nation.parquet'; "


@_query(NATION)
def jdbc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended by all tasks, and read as a table."""
    e, connect, _ = _database(spark, sf_dir)
    return e.sql(f"{connect}{LOAD_NATION}SELECT n_nationkey, n_name, n_regionkey FROM pg.nation")


@_query(f"SELECT 'first' AS load, n_nationkey FROM ({NATION}) WHERE n_nationkey >= 20 UNION ALL SELECT 'second', n_nationkey FROM ({NATION}) WHERE n_nationkey < 3")
def jdbc_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table held goes when it is replaced; the table itself stays."""
    e, connect, _ = _database(spark, sf_dir)
    load = "LOAD INTO pg.nation REPLACE WITH (auto_create = false) AS SELECT n_nationkey, n_name, n_regionkey, make_date(2024, 1, 1) AS day FROM 'nation.parquet' WHERE "
    first = e.sql(f"{connect}{LOAD_NATION}{load} n_nationkey >= 20; SELECT 'first' AS load, n_nationkey FROM pg.nation").collect()
    second = _sent(Engine(spark, e.run_)).sql(f"{connect}{load} n_nationkey < 3; SELECT 'second' AS load, n_nationkey FROM pg.nation").collect()
    return spark.createDataFrame([tuple(r) for r in [*first, *second]], "load string, n_nationkey long")  # some rows of 25


@_query("SELECT CAST(n_regionkey AS BIGINT) AS r, COUNT(*) AS n FROM nation GROUP BY 1")
def jdbc_raw_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, connect, _ = _database(spark, sf_dir)
    return e.sql(f"""{connect}{LOAD_NATION}SELECT "r", "n" FROM pg.QUERY('SELECT "n_regionkey" AS "r", COUNT(*) AS "n" FROM "nation" GROUP BY "n_regionkey"')""")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def jdbc_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicate goes to the server as it is written."""
    e, connect, _ = _database(spark, sf_dir)
    return e.sql(f"""PARAM r INT DEFAULT 1; {connect}{LOAD_NATION}SELECT n_nationkey, n_name FROM pg.nation PUSHDOWN ('"n_regionkey" = ' || $r)""")


@_query(f"SELECT k, n_nationkey, slices FROM ({NATION}) CROSS JOIN ({_values('k, slices', ('n_nationkey', 4), ('day', 4))})")
def jdbc_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read in slices of a whole-number key and of a date key, each a partition of its own; no row is lost or doubled."""
    e, connect, _ = _database(spark, sf_dir)
    frames = []
    for i, k in enumerate(("n_nationkey", "day")):
        df = (e if i == 0 else _sent(Engine(spark, e.run_))).sql(f"{connect}{LOAD_NATION if i == 0 else ''}SELECT '{k}' AS k, n_nationkey FROM pg.nation WITH (split = '{k}', slices = 4)")
        frames.append([(*r, df.rdd.getNumPartitions()) for r in df.collect()])
    return spark.createDataFrame(frames[0] + frames[1], "k string, n_nationkey long, slices long")  # 50 rows
