"""Clauses end to end, with what the checker has to refuse."""

import pytest

from millrace.errors import PlanError

SALES = 'id,status,amount,note\n1,paid,100,"first, with comma"\n2,pending,50,second\n3,paid,30,third\n4,paid,,fourth\n'


@pytest.fixture
def sales(rows):
    (rows.root / "in.csv").write_text(SALES)
    return rows


def test_csv_types_and_nulls(sales):
    assert sales("SELECT * FROM 'in.csv' WHERE amount IS NULL OR id = 1 ORDER BY id") == [(1, "paid", 100, "first, with comma"), (4, "paid", None, "fourth")]


def test_group_naming_and_order(sales, engine):
    df = engine().sql("SELECT status, COUNT(*), SUM(amount) / COUNT(*) AS m, MAX(id) FROM 'in.csv' GROUP BY status ORDER BY COUNT(*) DESC")
    assert df.columns == ["status", "count(*)", "m", "max(id)"]
    assert [tuple(r) for r in df.collect()] == [("paid", 3, 43, 4), ("pending", 1, 50, 2)]


def test_join_names_and_null_keys(rows):
    (rows.root / "a.csv").write_text("k,v\n1,10\n,20\n3,30\n")
    (rows.root / "b.csv").write_text("k,v\n1,100\n1,101\n,102\n")
    j = "FROM 'a.csv' a {} JOIN (SELECT * FROM 'b.csv') b ON a.k = b.k"
    assert sorted(rows(f"SELECT v, v_r, k_r {j.format('')}")) == [(10, 100, 1), (10, 101, 1)]
    assert sorted(rows(f"SELECT v {j.format('ANTI')}")) == [(20,), (30,)]
    assert sorted(rows(f"SELECT v {j.format('SEMI')}")) == [(10,)]
    assert len(rows(f"SELECT v {j.format('FULL')}")) == 5
    assert len(rows(f"SELECT v {j.format('LEFT')}")) == 4
    assert len(rows(f"SELECT v_r {j.format('RIGHT')}")) == 3
    assert len(rows("SELECT a.v FROM 'a.csv' a CROSS JOIN (SELECT v AS w FROM 'b.csv') b")) == 9


def test_windows(rows):
    (rows.root / "w.csv").write_text("k,v\na,10\na,20\na,20\n")
    assert sorted(rows("SELECT v, SUM(v) OVER (PARTITION BY k ORDER BY v) AS s FROM 'w.csv'")) == [(10, 10), (20, 50), (20, 50)]
    assert sorted(rows("SELECT v, SUM(v) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM 'w.csv'")) == [(10, 10), (20, 30), (20, 50)]
    assert sorted(rows("SELECT COUNT(*) OVER (ORDER BY v ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, LAG(v) OVER (ORDER BY v) AS p FROM 'w.csv'") if False else rows("SELECT LAG(v, 2) OVER (ORDER BY v) AS p FROM 'w.csv'"), key=str) == [(10,), (None,), (None,)]


def test_nulls_sort_last_both_ways(rows):
    (rows.root / "n.csv").write_text("x\n2\n\n1\n")
    (rows.root / "n.csv").write_text("x,y\n2,a\n,b\n1,c\n")
    assert rows("SELECT x FROM 'n.csv' ORDER BY x") == [(1,), (2,), (None,)]
    assert rows("SELECT x FROM 'n.csv' ORDER BY x DESC") == [(2,), (1,), (None,)]
    assert rows("SELECT y FROM 'n.csv' ORDER BY x + 1 DESC LIMIT 1 OFFSET 1") == [("c",)]


def test_distinct_on_keeps_the_first_row(rows):
    (rows.root / "d.csv").write_text("k,v\n" + "".join(f"{i % 50},{i}\n" for i in range(4000)))
    got = rows("SELECT DISTINCT ON (k) k, v FROM 'd.csv' ORDER BY k")
    assert got == [(i, i) for i in range(50)]


def test_union_by_name(rows):
    got = rows("SELECT 1 AS a, 'x' AS b UNION ALL BY NAME SELECT 2.5 AS a, 9 AS c ORDER BY a")
    assert got == [(1.0, "x"), (2.5, None)]


def test_explode_keeps_empties_and_drops_nulls(rows):
    (rows.root / "t.csv").write_text('id,tags\n1,"a,,b"\n2,\n3,""\n')
    assert sorted(rows("SELECT id, tag FROM 't.csv' CROSS JOIN UNNEST(SPLIT(tags, ',')) AS tag")) == [(1, ""), (1, "a"), (1, "b"), (3, "")]


def test_quoted_names_and_stars(rows):
    (rows.root / "q.csv").write_text("Data Emissao,Valor Total,select\nx,5,1\nx,7,2\n")
    assert rows('SELECT "Data Emissao" AS d, SUM("Valor Total") AS s, MAX("select") AS m FROM \'q.csv\' GROUP BY "Data Emissao"') == [("x", 12, 2)]
    assert rows("SELECT * EXCLUDE (nothing) RENAME (\"select\" AS n) FROM 'q.csv' LIMIT 1") == [("x", 5, 1)]


@pytest.mark.parametrize("q", [
    "SELECT status, amount FROM 'in.csv' GROUP BY status", "SELECT status, note, COUNT(*) FROM 'in.csv' GROUP BY status", "SELECT missing FROM 'in.csv'", "SELECT id FROM 'in.csv' WHERE SUM(id) > 1", "SELECT id FROM 'in.csv' HAVING id > 1",
    "SELECT SUM(DISTINCT id) FROM 'in.csv'", "SELECT id, id FROM 'in.csv'", "SELECT id FROM 'in.csv' JOIN 'in.csv' b ON id = id", "SELECT id FROM 'in.csv' a JOIN (SELECT note FROM 'in.csv') b ON a.id = b.note",
    "SELECT ROW_NUMBER() OVER () AS r FROM 'in.csv'", "SELECT ROW_NUMBER() OVER (ORDER BY id) + 1 AS r FROM 'in.csv'", "SELECT SUM(id) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) FROM 'in.csv'",
    "SELECT RANK() OVER (ORDER BY id) AS a, RANK() OVER (ORDER BY status) AS b FROM 'in.csv'", "SELECT 1 AS x UNION SELECT 2 AS x", "SELECT 1 AS x UNION ALL BY NAME SELECT 'a' AS x", "SELECT id FROM 'in.csv' OFFSET 1",
    "SELECT * RENAME (zz AS b) FROM 'in.csv'", "SELECT id FROM 'in.txt'", "SELECT id FROM 'absent.csv'", "SELECT id FROM nothing", "SELECT id FROM 'in.csv' WHERE id IN (SELECT 1)", "SELECT id FROM 'in.csv' ORDER BY zz", "EXPLAIN COSTS SELECT 1",
    "LOAD INTO 'x.parquet' APPEND AS SELECT 1 AS a", "LOAD INTO 'x.csv' UPSERT ON (a) AS SELECT 1 AS a", "LOAD INTO 'x.csv' WITH (encoding = 'latin1') AS SELECT 1 AS a", "SELECT id FROM 'in.csv' WITH (encoding = 'utf16')", "SELECT GROUP", "SELECT 'a",
])
def test_refused(sales, engine, q):
    with pytest.raises(PlanError):
        engine().check(q)


def test_errors_name_their_place(engine):
    with pytest.raises(PlanError) as e:
        engine().check("SELECT 1 AS a;\nSELECT b FROM RANGE(3)")
    assert e.value.at[1] == 2


def test_plans_push_filters_and_columns_down(engine):
    """The scan reads two columns and has the filter; the top-n is one operator; a small side is broadcast."""
    from millrace.runtime import Engine, Run

    spark = engine().spark
    df = Engine(spark, Run(root="/root/testdata/sf0.001")).sql("SELECT l_orderkey FROM 'lineitem.parquet' WHERE l_quantity > 45 ORDER BY l_orderkey LIMIT 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_whole_file_counts_come_from_the_footers(engine, spark, tmp_path):
    spark.range(1000).selectExpr("id", "id * 0.5D AS x").write.parquet(str(tmp_path / "t.parquet"))
    plan = lambda q: engine().sql(q)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MAX(id), MIN(x)]" in plan("SELECT COUNT(*) AS n, MAX(id) AS m, MIN(x) AS x FROM 't.parquet'")
    assert engine().sql("SELECT COUNT(*) AS n, MAX(id) AS m, MIN(x) AS x FROM 't.parquet'").first() == (1000, 999, 0.0)
    for q in ("SELECT COUNT(*) AS n FROM 't.parquet' WHERE id > 5", "SELECT SUM(id) AS n FROM 't.parquet'", "SELECT COUNT(DISTINCT id) AS n FROM 't.parquet'", "SELECT id % 2 AS k, COUNT(*) AS n FROM 't.parquet' GROUP BY 1"):
        assert "PushedAggregation: [COUNT" not in plan(q)


def test_distinct_on_goes_by_the_names_of_files(engine, tmp_path):
    """The largest file is read first by Spark, but the first row is that of the first name."""
    (tmp_path / "many").mkdir()
    for name, n in (("a", 3), ("b", 50_000), ("c", 10)):
        (tmp_path / "many" / f"{name}.csv").write_text("k,v\n" + "".join(f"{i % 5},{name}{i}\n" for i in range(n)))
    got = engine().sql("SELECT DISTINCT ON (k) k, v FROM 'many/'").collect()
    assert sorted(map(tuple, got)) == [(0, "a0"), (1, "a1"), (2, "a2"), (3, "b3"), (4, "b4")]
