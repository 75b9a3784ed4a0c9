"""The script layer: parameters, guards, functions, loops, includes, explain."""

import json

import pytest

from millrace.cli import main, params
from millrace.errors import PlanError, RunError, Thrown
from millrace.runtime import exit_code


def test_params_lets_and_documents(rows):
    s = "PARAM n INT DEFAULT 2; PARAM d DATE DEFAULT '2024-01-31'; LET m = $n * 10; LET tag = 'x' || $m; SELECT $n AS n, $m AS m, $tag AS t, $d AS d"
    assert [str(v) for v in rows(s, params={"n": "3"})[0]] == ["3", "30", "x30", "2024-01-31"]
    doc = "PARAM job JSON FROM BODY; SELECT $job.a.b AS b, $job.zz?.c AS c"
    assert rows(doc, request_body={"a": {"b": 7}}) == [(7, None)]


@pytest.mark.parametrize(("script", "run"), [
    ("PARAM n INT; SELECT $n AS n", {}), ("PARAM n INT; SELECT $n AS n", {"params": {"n": "x"}}), ("LET n = 1; SELECT $n AS n", {"params": {"n": "2"}}), ("PARAM n INT DEFAULT 1; LET n = 2; SELECT 1 AS a", {}),
    ("SELECT 1 AS a", {"params": {"zz": "1"}}), ("CREATE FUNCTION f(a) AS f(a) + 1; SELECT f(1) AS x", {}), ("CREATE FUNCTION f(a) AS a; SELECT f(1, 2) AS x", {}), ("CREATE FUNCTION f(a INT) AS a; SELECT f('x') AS x", {}), ("CALL nothing(1)", {}),
])
def test_bad_scope_is_refused(engine, script, run):
    with pytest.raises(PlanError):
        engine(**run).check(script)


def test_throw(engine):
    engine().check("THROW 'no' WHEN 1 > 2; SELECT 1 AS a")
    with pytest.raises(Thrown, match="tbl is required"):
        engine().check("PARAM tbl STRING DEFAULT ''; THROW 'tbl is required' WHEN $tbl IS EMPTY; SELECT 1 AS a")


def test_functions_inline(rows):
    assert rows("CREATE FUNCTION twice(x) AS x * 2; CREATE FUNCTION g(a, b DEFAULT 10) AS twice(a) + b; SELECT g(range) AS v FROM RANGE(1, 3) ORDER BY v") == [(12,), (14,)]


def test_print_and_call(engine, tmp_path):
    said = []
    engine(log=said.append).run("CREATE FUNCTION load(n, k DEFAULT 1) AS PRINT 'loading ' || $n; LOAD INTO IDENTIFIER('out_' || $n || '.csv') AS SELECT $k AS k, $n AS n; END; CALL load('a'); CALL load('b', 5)")
    assert said == ["loading a", "loading b"]
    assert (tmp_path / "out_b.csv").read_text() == "k,n\n5,b\n"


@pytest.mark.parametrize("mode", ["SEQUENTIAL", "PARALLEL"])
def test_for_each(engine, tmp_path, mode):
    e = engine(request_body={"tables": [{"name": "a", "n": 1}, {"name": "b", "n": 0}, {"name": "c", "n": 3}]})
    out = e.run(f"""PARAM job JSON FROM BODY;
        FOR EACH ROW OF ($job.tables) AS (name, n:INT) {mode} ON ERROR CONTINUE
          CASE WHEN n = 0 THEN LOAD INTO IDENTIFIER($name || '.csv') AS SELECT CAST('x' || $name AS INT) AS bad;
          ELSE LOAD INTO IDENTIFIER(lower($name) || '.csv') AS SELECT $name AS name, range AS i FROM RANGE(3) WHERE range < $n; END CASE;
        END FOR""")
    assert [bool(r.error) for r in out].count(True) == 1
    assert (tmp_path / "c.csv").read_text().count("\n") == 4
    assert (tmp_path / "a.csv").read_text() == "name,i\na,0\n"


def test_for_each_of_a_query_stops_on_errors(engine):
    with pytest.raises(Exception):  # noqa: B017
        engine().run("FOR EACH ROW OF (SELECT range AS r FROM RANGE(2)) AS (r) LOAD INTO 'x.csv' AS SELECT 1 / $r AS v; END FOR")


def test_case_statement_and_subject(rows):
    s = "PARAM env STRING DEFAULT 'prod'; CASE $env WHEN 'prod', 'staging' THEN SELECT 1 AS a; ELSE SELECT 2 AS a; END CASE"
    assert rows(s) == [(1,)] and rows(s, params={"env": "dev"}) == [(2,)]


def test_includes(engine, tmp_path):
    (tmp_path / "lib.sql").write_text("CREATE FUNCTION plus(a) AS a + 1;")
    (tmp_path / "loop.sql").write_text("@include 'loop.sql'; SELECT 1 AS a")
    assert engine().run("@include 'lib.sql'; SELECT plus(1) AS a", str(tmp_path / "main.sql"))[0].df.first()[0] == 2
    with pytest.raises(PlanError):
        engine().run("@include 'loop.sql'; SELECT 1 AS a", str(tmp_path / "main.sql"))


def test_explain_writes_nothing(engine, tmp_path):
    (tmp_path / "e.csv").write_text("g,v\na,10\na,20\nb,30\n")
    for form in ("EXPLAIN", "EXPLAIN ANALYZE"):
        text = engine().run(f"{form} LOAD INTO 'o.csv' AS SELECT g, SUM(v) AS s FROM 'e.csv' GROUP BY g")[0].text
        assert "HashAggregate" in text and "g STRING, s INT" in text
    assert not (tmp_path / "o.csv").exists()


def test_templates(engine):
    from millrace.lang import ast as A

    e = engine()
    assert e.template("SELECT ${cols} FROM ${lower(name) || '_t'} WHERE a = '${ 1 + 1 }'", {"cols": A.Lit("a, b", A.STRING), "name": A.Lit("X", A.STRING)}) == "SELECT a, b FROM x_t WHERE a = '2'"


def test_discovered_union(engine, tmp_path):
    (tmp_path / "t1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "t2.csv").write_text("b,a,z\n4,3,9\n")
    e = engine(request_body={"tables": [{"table": "t1.csv", "tag": "x"}, {"table": "t2.csv", "tag": "y"}]})
    assert sorted(map(tuple, e.sql("PARAM job JSON FROM BODY; SELECT * FROM EACH TABLE OF ($job.tables) AS (table_name, tag)").collect())) == [("x", 1, 2), ("y", 3, 4)]


def test_cli(capsys, tmp_path, spark):
    assert main(["run", "-c", "SELECT 1 AS a, 'x' AS b", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out) == {"a": 1, "b": "x"}
    assert main(["check", "-c", "SELECT zz AS a"]) == 1
    assert main(["run", "-c", "PRINT 'hi'; SELECT 2.5 AS v", "-q"]) == 0
    assert params(["a=b=c"]) == {"a": "b=c"}
    assert exit_code(RunError("x", transient=True)) == 75 and exit_code(KeyboardInterrupt()) == 130 and exit_code(PlanError("x")) == 1
