"""Files, archives, prefixes, dispositions, REST, SQL text, buffers, the HTTP host."""

import gzip
import http.server
import json
import threading
import urllib.request
import zipfile

import pytest
import zstandard

from millrace.errors import PlanError
from millrace.lang import ast as A
from millrace.sinks import files as file_sinks
from millrace.sinks import sql
from millrace.sources import csvtypes, files, jdbc, rest
from millrace.streaming import drain, wal
from millrace.streaming.serve import Host
from millrace.runtime import Run


def test_sniffing():
    rows = csvtypes.records('a,b,c,d,e\n007,+1,"5",1.5,\n1,2,3,4,\n', ",")
    assert {n: t.kind for n, t in csvtypes.schema(rows).items()} == {"a": "string", "b": "string", "c": "string", "d": "float", "e": "string"}


def test_round_trip_keeps_empty_apart_from_null(engine, tmp_path):
    (tmp_path / "s.csv").write_text('id,s\n1,""\n2,\n3,x\n')
    engine().run("LOAD INTO 'a.csv' AS SELECT * FROM 's.csv' ORDER BY id; LOAD INTO 'b.csv' AS SELECT * FROM 'a.csv' ORDER BY id")
    assert (tmp_path / "b.csv").read_text() == 'id,s\n1,""\n2,\n3,x\n'


def test_csv_quoting_zero_rows_and_append(engine, tmp_path):
    engine().run("LOAD INTO 'q.csv' AS SELECT 'a,\"b\"' AS x, 'l1\nl2' AS y, 1.0 AS z")
    assert (tmp_path / "q.csv").read_text() == 'x,y,z\n"a,""b""","l1\nl2",1\n'
    assert [tuple(r) for r in engine().sql("SELECT * FROM 'q.csv'").collect()] == [('a,"b"', "l1\nl2", 1)]
    engine().run("LOAD INTO 'z.csv' AS SELECT range FROM RANGE(0)")
    assert (tmp_path / "z.csv").read_text() == "range\n"
    for _ in range(2):
        engine().run("LOAD INTO 'p.csv' APPEND AS SELECT 1 AS a")
    assert (tmp_path / "p.csv").read_text() == "a\n1\n1\n"
    engine().run("LOAD INTO 'p.csv' REPLACE AS SELECT 2 AS a")
    assert (tmp_path / "p.csv").read_text() == "a\n2\n"


@pytest.mark.parametrize("codec", ["none", "gzip", "zstd", "snappy", "lz4"])
def test_parquet(engine, tmp_path, spark, codec):
    spark.range(60).selectExpr("id", "concat('row-', id) AS name", "id * 1.5D AS amt", "id % 2 = 0 AS flag").coalesce(1).write.option("compression", codec).parquet(str(tmp_path / "d.parquet"))
    engine().run("LOAD INTO 'o.parquet' AS SELECT * FROM 'd.parquet'; LOAD INTO 'o.csv' AS SELECT * FROM 'o.parquet' ORDER BY id")
    assert (tmp_path / "o.parquet").is_file()
    assert (tmp_path / "o.csv").read_text().splitlines()[:3] == ["id,name,amt,flag", "0,row-0,0,true", "1,row-1,1.5,false"]


def test_nested_parquet_columns(engine, tmp_path, spark):
    spark.sql("SELECT named_struct('city', 'x', 'zip', 5) AS addr, array(1, 2) AS xs, 3 AS n").write.parquet(str(tmp_path / "n.parquet"))
    assert engine().sql("SELECT \"addr.city\" AS c, n FROM 'n.parquet'").collect()[0] == ("x", 3)


def test_codecs_zip_and_prefix(engine, tmp_path):
    text = b"a;b\n1;x\xe9\n"
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    (tmp_path / "z.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(b"a,b\n3,4\n"))
    (tmp_path / "l.csv").write_bytes(text)
    (tmp_path / "t.dat").write_text("a\tb\n5\t6\n")
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("in.csv", "a,b\n7,8\n")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("in.csv", "a,b\n9,10\n")
        z.writestr("other.csv", "c\n1\n")
    (tmp_path / "many").mkdir()
    for i in (1, 2):
        (tmp_path / "many" / f"p{i}.csv").write_text(f"a,b\n{i},{i}\n")
    get = lambda s: sorted(tuple(r) for r in engine().sql(s).collect())
    assert get("SELECT * FROM 'g.csv.gz'") == [(1, 2)] and get("SELECT * FROM 'z.csv.zst'") == [(3, 4)]
    assert get("SELECT * FROM 'l.csv' WITH (delimiter = ';', encoding = 'latin1')") == [(1, "xé")] == get("SELECT * FROM 'l.csv' WITH (delimiter = ';', encoding = 'cp1252')")
    assert get("SELECT * FROM 't.dat' WITH (format = 'csv', delimiter = tab)") == [(5, 6)]
    assert get("SELECT * FROM 'one.zip'") == [(7, 8)] and get("SELECT * FROM 'two.zip :: in.csv'") == [(9, 10)]
    assert get("SELECT * FROM 'many/'") == [(1, 1), (2, 2)]
    (tmp_path / "many" / "p3.csv").write_text("a,c\n1,1\n")
    for bad in ("'two.zip'", "'two.zip :: zz.csv'", "'many/'", "'x.parquet.gz'"):
        with pytest.raises(PlanError):
            engine().check(f"SELECT * FROM {bad}")


def test_buffered_source_may_be_its_own_sink(engine, tmp_path):
    (tmp_path / "s.csv").write_text("a\n1\n2\n")
    engine().run("LOAD INTO 's.csv' REPLACE AS SELECT a + 1 AS a FROM 's.csv' WITH (buffer) ORDER BY a")
    assert (tmp_path / "s.csv").read_text() == "a\n2\n3\n"


def test_late_bad_cell_is_an_error_of_the_run(engine, tmp_path):
    (tmp_path / "b.csv").write_text("a,b\n" + "1,2\n" * 1100 + "x,2\n")
    df = engine().sql("SELECT SUM(a) AS s FROM 'b.csv'")
    with pytest.raises(Exception):  # noqa: B017
        df.collect()


def test_addresses():
    assert files.located("az://acct/box/a/b.csv") == "abfss://box@acct.dfs.core.windows.net/a/b.csv" and files.located("s3://b/k.parquet") == "s3a://b/k.parquet"


class _Api(http.server.BaseHTTPRequestHandler):
    busy = 1
    rows = [{"id": i, "name": f"n{i}", "tags": [i]} for i in range(7)]

    def do_GET(self):
        from urllib.parse import parse_qs, urlsplit

        parts = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(parts.query).items()}
        if parts.path == "/busy" and _Api.busy:
            _Api.busy -= 1
            self.send_response(503)
            self.end_headers()
            return
        if parts.path == "/file.csv":
            out = b"a,b\n1,2\n"
        else:
            if parts.path == "/secret" and self.headers.get("Authorization") != "Bearer tok":
                self.send_response(401)
                self.end_headers()
                return
            size = int(q.get("per_page", q.get("limit", 3)))
            start = int(q["cursor"]) if "cursor" in q else int(q["offset"]) if "offset" in q else (int(q.get("page", 1)) - 1) * size
            doc = {"meta": {"total": 7}, "data": self.rows[start : start + size], "next": str(start + size) if start + size < 7 else None}
            out = json.dumps(doc).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def api():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Api)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


@pytest.mark.parametrize("clause", ["PAGINATE BY page (size = 3, total = 'meta.total')", "PAGINATE BY page (size = 3)", "PAGINATE BY offset (size = 3)", "PAGINATE BY cursor (field = 'next', size = 3)"])
def test_rest_pages(engine, api, clause):
    got = engine().sql(f"SELECT id, name, tags FROM HTTP('{api}/x') {clause} WITH (items = 'data') ORDER BY id").collect()
    assert [r[0] for r in got] == list(range(7)) and got[3][2] == "[3]"


def test_rest_retry_auth_and_max(engine, api):
    _Api.busy = 1
    assert engine().sql(f"SELECT COUNT(*) AS n FROM HTTP('{api}/busy') RETRY 2 ON (503) WITH (items = 'data')").first()[0] == 3
    s = f"CREATE CONNECTION crm TYPE http OPTIONS (base_url = '{api}', auth = 'bearer', token = 'tok'); SELECT COUNT(*) AS n FROM crm.'/secret' PAGINATE BY page (size = 3, max = 2) WITH (items = 'data')"
    assert engine().sql(s).first()[0] == 6
    with pytest.raises(Exception):  # noqa: B017
        engine().sql(f"SELECT COUNT(*) AS n FROM HTTP('{api}/secret')")
    assert engine().sql(f"SELECT * FROM '{api}/file.csv'").first() == (1, 2)


def test_pages_without_a_total_stay_off_the_driver(engine, api, monkeypatch):
    """They come back from a file: the frame holds no more than the first page itself."""
    df = engine().sql(f"SELECT id FROM HTTP('{api}/x') PAGINATE BY cursor (field = 'next', size = 2) WITH (items = 'data')")
    assert "FileScan json" in df._jdf.queryExecution().executedPlan().toString() and sorted(r[0] for r in df.collect()) == list(range(7))


def test_a_parquet_file_does_not_narrow_the_plan(engine, spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "d.parquet"))
    df = engine().sql("SELECT id FROM 'd.parquet' WHERE id > 3")
    assert "Exchange SinglePartition" in file_sinks.single(df)._jdf.queryExecution().executedPlan().toString() or "REPARTITION_BY_NUM" in file_sinks.single(df)._jdf.queryExecution().executedPlan().toString()
    ordered = engine().sql("SELECT id FROM 'd.parquet' ORDER BY id DESC")
    assert [r[0] for r in file_sinks.single(ordered).collect()] == list(range(99, -1, -1))


def test_buffered_sources_are_given_back(engine, spark, tmp_path):
    (tmp_path / "s.csv").write_text("a\n1\n2\n")
    e = engine()
    e.run("LOAD INTO 's.csv' REPLACE AS SELECT a + 1 AS a FROM 's.csv' WITH (buffer)")
    assert not e.held
    assert e.sql("SELECT a FROM 's.csv' WITH (buffer)").count() == 2 and e.held


def test_rest_rows_coerce():
    s = rest.inferred([{"a": 1, "b": "x"}])
    assert rest.coerce({"a": "5", "c": 1}, s) == (5, None)


def test_sql_text():
    pg, my, ms = (jdbc.Connection("c", t, {"host": "h", "database": "d", "user": "u", "password": "p"}) for t in ("postgres", "mysql", "sqlserver"))
    assert pg.url() == "jdbc:postgresql://h:5432/d" and my.url() == "jdbc:mysql://h:3306/d" and ms.url().startswith("jdbc:sqlserver://h;databaseName=d")
    assert jdbc.query_of(pg, "s", "t", None, "a > 1") == 'SELECT * FROM "s"."t" WHERE a > 1'
    assert jdbc.query_of(my, None, None, "SELECT 1", None) == "SELECT 1"
    assert jdbc.slices("id", 0, 99, 4, "postgres") == ['"id" < 25 OR "id" IS NULL', '"id" >= 25 AND "id" < 50', '"id" >= 50 AND "id" < 75', '"id" >= 75']
    assert len(jdbc.uuid_slices("id", 4, "postgres")) == 4
    assert "'\"s\".\"t\"'::regclass" in jdbc.rows_query(pg, "s", "t") and "DATABASE()" in jdbc.rows_query(my, None, "t") and "OBJECT_ID(N's.t')" in jdbc.rows_query(ms, "s", "t")
    assert "ON CONFLICT (\"k\") DO UPDATE SET \"v\" = EXCLUDED.\"v\"" in sql.upsert_statement(pg, None, "t", "s", ["k", "v"], ["k"])
    assert "ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)" in sql.upsert_statement(my, None, "t", "s", ["k", "v"], ["k"])
    assert sql.upsert_statement(ms, None, "t", "s", ["k", "v", "w"], ["k"], ["w"]).count("t.[v]") == 0
    types = {"k": A.STRING, "v": A.Type("decimal", 10, 2)}
    assert sql.create_statement(my, None, "t", types, ["k"]) == "CREATE TABLE IF NOT EXISTS `t` (`k` VARCHAR(255) NOT NULL, `v` DECIMAL(10,2), PRIMARY KEY (`k`))"
    with pytest.raises(PlanError):
        jdbc.Connection("c", "sqlserver", {"host": "h", "auth": "ntlm", "tls": "off"}).url()


def test_stream_load(engine):
    """Rows arrive as TSV under labels that depend on the run alone."""
    got = []

    class Fe(http.server.BaseHTTPRequestHandler):
        def do_PUT(self):
            got.append((self.headers["label"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"Status": "Success"}')

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Fe)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    engine(label="run7").run(f"CREATE CONNECTION sr TYPE starrocks OPTIONS (be_url = 'http://127.0.0.1:{s.server_port}', database = 'd', auto_create = false); LOAD INTO sr.t USING stream_load WITH (auto_create = false) AS SELECT range AS id, NULLIF('x', 'x') AS n FROM RANGE(2)")
    s.shutdown()
    assert "".join(b for _, b in sorted(got)) == "0\t\\N\n1\t\\N\n" and all(x.startswith("run7_") for x, _ in got)


def test_buffer_survives_a_crash(tmp_path):
    b = wal.Buffer(str(tmp_path / "q"), segment_bytes=60, max_bytes=400)
    for i in range(5):
        b.append([{"i": i, "t": "x" * 10}])
    assert b.pending()
    open_ = [p for p in (tmp_path / "q").iterdir() if p.name.startswith("open-")][0]
    with open(open_, "ab") as f:
        f.write(b'{"i": 9, "half')
    again = wal.Buffer(str(tmp_path / "q"), segment_bytes=60, max_bytes=400)
    rows = [json.loads(line) for s in again.pending() for line in open(again.path(s))]
    assert [r["i"] for r in rows] == list(range(5))
    with pytest.raises(wal.Full):
        again.append([{"t": "y" * 500}])
    first = again.pending()[0]
    again.mark_loaded(first)
    assert first not in again.pending() and wal.Buffer(str(tmp_path / "q")).pending() == again.pending()


def test_structured_streaming_drain(spark, tmp_path):
    b = wal.Buffer(str(tmp_path / "q"))
    columns = [("i", A.INT, True), ("s", A.STRING, False)]
    seen = {}
    for part in ([{"i": 1, "s": "a"}, {"i": 2, "s": None}], [{"i": 3, "s": "c"}]):
        b.append(part)
        b.rotate()
        q = drain.stream(spark, b.ready, columns, str(tmp_path / "cp"), lambda df, n: seen.__setitem__(n, sorted(r[0] for r in df.collect())), once=True)
        q.awaitTermination(60)
    assert seen == {0: [1, 2], 1: [3]}
    assert drain.replay(spark, b.root, columns).count() == 3


ENDPOINT = """CREATE ENDPOINT '/in' ACCEPT BODY (event STRING NOT NULL, value STRING) INTO BUFFER 'q' AT 'wal' SEGMENT 1 MB MAX 1 GB RETAIN UNTIL LOADED;
LOAD INTO 'loaded.csv' APPEND AS SELECT event AS kind, CAST(value AS INT) AS v FROM BUFFER 'q' AT 'wal' FLUSH EVERY 1 SECONDS OR 2 ROWS WHERE event <> 'debug' ORDER BY v;"""
DIRECT = "CREATE ENDPOINT '/sum'; PARAM k INT DEFAULT 1; SELECT SUM(v) * $k AS s FROM BODY (v INT NOT NULL);"


def test_host(spark, tmp_path):
    (tmp_path / "in.sql").write_text(ENDPOINT)
    (tmp_path / "sum.sql").write_text(DIRECT)
    h = Host(spark, str(tmp_path), Run(root=str(tmp_path), log=lambda s: None))
    server = h.server("127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, doc=None):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(doc).encode() if doc is not None else None) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("/healthz")[0] == 200 and call("/readyz")[1]["routes"] == ["/in", "/sum"] and call("/zz")[0] == 404
    assert call("/sum?k=10", [{"v": 1}, {"v": 2}]) == (200, {"outputs": 1, "rows": [{"s": 30}]})
    assert call("/sum", [{"v": None}])[0] == 422 and call("/in", {"value": "1"})[0] == 422
    assert call("/in", [{"event": "a", "value": "2"}, {"event": "debug", "value": "9"}, {"event": "b", "value": "1", "more": 1}]) == (200, {"accepted": 3})
    route = h.routes["/in"]
    assert route.buffer.due(*route.flush)
    route.buffer.rotate()
    assert h.drain(route) == 1 and h.drain(route) == 0
    assert (tmp_path / "loaded.csv").read_text() == "kind,v\nb,1\na,2\n"
    server.shutdown()
