"""Pairs of a dialect script and the DuckDB query with the same result."""

from __future__ import annotations

QUERIES: dict[str, tuple[str, str]] = {}


def _add(name: str, script: str, oracle: str | None = None) -> None:
    """Without an oracle of its own, the script reads as DuckDB's SQL once file names are table names."""
    QUERIES[name] = script, oracle if oracle is not None else script.replace(".parquet'", "").replace("FROM '", "FROM ").replace("JOIN '", "JOIN ")


L, O, E, P, C = "'lineitem.parquet'", "'orders.parquet'", "'events.parquet'", "'part.parquet'", "'customer.parquet'"

# -- scans, projections, predicates
_add("scan_project", f"SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderpriority FROM {O}")
_add("filter_3vl", f"SELECT event_id, value FROM {E} WHERE NOT (NULLIF(event_type, 'click') = 'view' AND value > 50) OR NULLIF(event_type, 'error') IS NULL")
_add("filter_in", f"SELECT event_id FROM {E} WHERE event_type IN ('click', 'view')")
_add("filter_not_in", f"SELECT event_id FROM {E} WHERE user_id NOT IN (1, 2, 3, NULL) OR event_type NOT IN ('click', 'view', 'error')")
_add("filter_between", f"SELECT o_orderkey FROM {O} WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate NOT BETWEEN '1996-01-01' AND '1997-12-31'", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate NOT BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
_add("filter_like", f"SELECT p_partkey, p_name FROM {P} WHERE p_name LIKE '%a_' OR p_type NOT LIKE '%O%'")
_add("is_null_coalesce", f"SELECT event_id, NULLIF(event_type, 'click') ?? 'none' AS kind, COALESCE(NULLIF(user_id, 5), -1) AS u, NULLIF(event_type, 'view') IS NULL AS viewed, replace(event_type, 'click', '') IS NOT EMPTY AS full FROM {E}",
     "SELECT event_id, COALESCE(NULLIF(event_type, 'click'), 'none') AS kind, COALESCE(NULLIF(user_id, 5), -1) AS u, NULLIF(event_type, 'view') IS NULL AS viewed, NOT (replace(event_type, 'click', '') = '') AS \"full\" FROM events")
_add("case_subject", f"SELECT event_id, CASE event_type WHEN 'click', 'view' THEN 'look' WHEN 'purchase' THEN 'buy' END AS kind FROM {E}", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'look' WHEN event_type = 'purchase' THEN 'buy' END AS kind FROM events")
_add("case_guard", f"SELECT event_id, CASE WHEN value > 100 THEN 2 WHEN value > 10 THEN 1 ELSE 0 END AS size, IF(value > 50, 'hi', 'lo') AS half FROM {E}", "SELECT event_id, CAST(CASE WHEN value > 100 THEN 2 WHEN value > 10 THEN 1 ELSE 0 END AS BIGINT) AS size, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS half FROM events")
_add("arith_int", f"SELECT o_orderkey, o_custkey + 7 AS a, o_custkey - 1000 AS b, o_custkey * 3 AS c, (o_custkey - 700) / 7 AS d, (o_custkey - 700) % 7 AS e FROM {O}", "SELECT o_orderkey, o_custkey + 7 AS a, o_custkey - 1000 AS b, o_custkey * 3 AS c, (o_custkey - 700) // 7 AS d, (o_custkey - 700) % 7 AS e FROM orders")
_add("arith_float", f"SELECT event_id, value / 3 AS a, value / 4.0 AS b, value - 0.5 AS c, -value AS d, value / NULLIF(value - value, 1.0) AS z FROM {E}", "SELECT event_id, value / 3 AS a, value / 4.0::DOUBLE AS b, value - 0.5::DOUBLE AS c, -value AS d, CASE WHEN value = 0 THEN 'nan'::DOUBLE WHEN value > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS z FROM events")
_add("bitwise", f"SELECT event_id, event_id & 12 AS a, event_id | 5 AS b, event_id ^ 9 AS c, event_id << 3 AS d, event_id >> 2 AS e, ~event_id AS f, event_id << 64 AS g, (-event_id - 1) >> 70 AS h FROM {E}", "SELECT event_id, event_id & 12 AS a, event_id | 5 AS b, xor(event_id, 9) AS c, event_id << 3 AS d, event_id >> 2 AS e, ~event_id AS f, 0::BIGINT AS g, -1::BIGINT AS h FROM events")
_add("cast_try", f"SELECT event_id, CAST(value AS INT) AS i, CAST(event_id AS STRING) AS s, TRY_CAST(event_type AS INT) AS bad, CAST(event_id % 2 AS BOOL) AS odd, CAST(substr(CAST(ts AS STRING), 1, 10) AS DATE) AS d, CAST(user_id AS FLOAT) AS f FROM {E}",
     "SELECT event_id, CAST(trunc(value) AS BIGINT) AS i, CAST(event_id AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS bad, event_id % 2 = 1 AS odd, CAST(ts AS DATE) AS d, CAST(user_id AS DOUBLE) AS f FROM events")
_add("cast_decimal", f"SELECT o_orderkey, CAST('1.239' AS DECIMAL(10,2)) AS t, CAST(o_totalprice AS DECIMAL(18,2)) AS m FROM {O}", "SELECT o_orderkey, CAST('1.23' AS DECIMAL(10,2)) AS t, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS m FROM orders")
# -- functions
_add("fn_string", f"SELECT p_partkey, UPPER(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, trim('  ' || p_brand || ' ') AS t, substr(p_name, 2, 3) AS s, replace(p_name, 'a', 'o') AS r, starts_with(p_name, 'p') AS sw, ends_with(p_name, '1') AS ew, contains(p_name, 'ar') AS c, strpos(p_name, 'a') AS p, split_part(p_name, ' ', 2) AS sp, reverse(p_type) AS rv FROM {P}",
     "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, strlen(p_name) AS n, trim('  ' || p_brand || ' ') AS t, substr(p_name, 2, 3) AS s, replace(p_name, 'a', 'o') AS r, starts_with(p_name, 'p') AS sw, ends_with(p_name, '1') AS ew, contains(p_name, 'ar') AS c, strpos(p_name, 'a') AS p, split_part(p_name, ' ', 2) AS sp, reverse(p_type) AS rv FROM part")
_add("fn_string_pad", f"SELECT p_partkey, lpad(p_type, 12, '*') AS a, rpad(p_type, 3, '-') AS b, left(p_name, 4) AS c, right(p_name, 3) AS d, left(p_name, -2) AS e, right(p_name, -2) AS f, repeat('ab', p_size % 3) AS g, concat(p_type, '-', p_size) AS h FROM {P}",
     "SELECT p_partkey, lpad(p_type, 12, '*') AS a, rpad(p_type, 3, '-') AS b, left(p_name, 4) AS c, right(p_name, 3) AS d, left(p_name, -2) AS e, right(p_name, -2) AS f, repeat('ab', p_size % 3) AS g, p_type || '-' || p_size AS h FROM part")
_add("fn_math", f"SELECT event_id, abs(value - 50) AS a, floor(value) AS f, ceil(value) AS c, round(value) AS r, mod(event_id, 7) AS m, mod(event_id, 0) AS mz, power(2, event_id % 10) AS p, sqrt(event_id) AS q, sqrt(0 - event_id - 1) AS qn, sign(value - 50) AS s FROM {E}",
     "SELECT event_id, abs(value - 50) AS a, floor(value) AS f, ceil(value) AS c, round(value) AS r, event_id % 7 AS m, CAST(NULL AS BIGINT) AS mz, power(2.0::DOUBLE, event_id % 10) AS p, sqrt(event_id) AS q, CAST(NULL AS DOUBLE) AS qn, CAST(sign(value - 50) AS BIGINT) AS s FROM events")
_add("fn_nullsel", f"SELECT event_id, nullif(user_id, 3) AS n, greatest(user_id, event_id, NULL) AS g, least(user_id, event_id % 50) AS l FROM {E}", "SELECT event_id, nullif(user_id, 3) AS n, greatest(user_id, event_id) AS g, least(user_id, event_id % 50) AS l FROM events")
_add("fn_date_trunc_extract", f"SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('month', ts) AS m, extract(day FROM ts) AS d, extract('minute', ts) AS mi, extract(second FROM ts) AS s, extract(year FROM ts) AS y FROM {E}",
     "SELECT event_id, date_trunc('hour', ts) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, extract(day FROM ts) AS d, extract(minute FROM ts) AS mi, extract(second FROM ts) AS s, extract(year FROM ts) AS y FROM events")
_add("fn_date_add_diff", f"SELECT o_orderkey, date_add('month', 1, o_orderdate) AS m, date_add('day', -3, o_orderdate) AS d, date_diff('year', o_orderdate, '2001-08-01') AS y, date_diff('month', o_orderdate, '2001-08-01') AS mo, date_diff('day', o_orderdate, '2001-08-01') AS dd, make_date(2024, 2, 29) AS leap FROM {O}",
     "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 3 DAY AS d, datediff('year', o_orderdate, TIMESTAMP '2001-08-01') AS y, datediff('month', o_orderdate, TIMESTAMP '2001-08-01') AS mo, datesub('day', o_orderdate, TIMESTAMP '2001-08-01') AS dd, DATE '2024-02-29' AS leap FROM orders")
_add("fn_strftime_epoch", f"SELECT event_id, strftime(ts, '%Y/%m/%d at %H:%M:%S') AS t, epoch(ts) AS e, to_timestamp(epoch(ts)) AS b FROM {E}", "SELECT event_id, strftime(ts, '%Y/%m/%d at %H:%M:%S') AS t, CAST(floor(epoch(ts)) AS BIGINT) AS e, date_trunc('second', ts) AS b FROM events")
_add("fn_regexp_first", rf"SELECT p_partkey, regexp_replace(p_name, '([a-z])([a-z]+)', '<\2\1>') AS r, regexp_replace(p_type, 'O|A', '_') AS f FROM {P}", r"SELECT p_partkey, regexp_replace(p_name, '([a-z])([a-z]+)', '<\2\1>') AS r, regexp_replace(p_type, 'O|A', '_') AS f FROM part")
_add("fn_hex", f"SELECT event_id, to_hex(event_id) AS h, from_hex(to_hex(event_id)) AS b, bit_count(event_id) AS n, to_hex(0 - 1) AS m FROM {E}", "SELECT event_id, lower(to_hex(event_id)) AS h, event_id AS b, CAST(bit_count(event_id) AS BIGINT) AS n, 'ffffffffffffffff' AS m FROM events")
# -- aggregation
_add("agg_global", f"SELECT COUNT(*) AS n, COUNT(NULLIF(event_type, 'click')) AS k, SUM(user_id) AS s, MIN(value) AS lo, MAX(ts) AS hi FROM {E}", "SELECT COUNT(*) AS n, COUNT(NULLIF(event_type, 'click')) AS k, CAST(SUM(user_id) AS BIGINT) AS s, MIN(value) AS lo, MAX(ts) AS hi FROM events")
_add("agg_grouped", f"SELECT event_type, COUNT(*) AS n, ROUND(AVG(value), 6) AS a, ROUND(SUM(value), 4) AS s, MIN(user_id) AS lo FROM {E} GROUP BY event_type")
_add("agg_count_distinct", f"SELECT event_type, COUNT(DISTINCT user_id) AS u, COUNT(*) AS n, COUNT(DISTINCT NULLIF(user_id, 3)) AS v FROM {E} GROUP BY event_type")
_add("agg_expr_key", f"SELECT user_id % 10 AS k, COUNT(*) AS n FROM {E} GROUP BY user_id % 10")
_add("agg_alias_key", f"SELECT date_trunc('day', ts) AS d, MAX(value) AS m FROM {E} GROUP BY d", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, MAX(value) AS m FROM events GROUP BY 1")
_add("agg_positional", f"SELECT event_type, user_id % 3 AS k, COUNT(*) AS n FROM {E} GROUP BY 1, 2")
_add("agg_in_expression", f"SELECT l_returnflag, ROUND(SUM(l_extendedprice) / COUNT(*), 4) AS m, MAX(l_orderkey) - MIN(l_orderkey) AS d FROM {L} GROUP BY l_returnflag")
_add("agg_having_hidden", f"SELECT user_id, COUNT(*) AS n FROM {E} GROUP BY user_id HAVING MAX(value) > 90 AND COUNT(*) > 5")
_add("agg_null_group", f"SELECT NULLIF(event_type, 'view') AS k, COUNT(*) AS n FROM {E} GROUP BY NULLIF(event_type, 'view')")
_add("agg_constant_tag", f"LET tag = 'run-' || 7; SELECT $tag AS tag, event_type, COUNT(*) AS n, 1 + 2 AS three FROM {E} GROUP BY event_type", "SELECT 'run-7' AS tag, event_type, COUNT(*) AS n, 3::BIGINT AS three FROM events GROUP BY event_type")
_add("agg_sum_text", f"SELECT SUM(CAST(user_id AS STRING)) AS s FROM {E}", "SELECT CAST(SUM(user_id) AS BIGINT) AS s FROM events")
_add("agg_sum_decimal", f"SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS STRING) AS s FROM {O} GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(SUM(CAST(round(o_totalprice, 2) AS DECIMAL(18,2))) AS VARCHAR) AS s FROM orders GROUP BY o_orderpriority")
_add("agg_empty", f"SELECT COUNT(*) AS n, SUM(user_id) AS s FROM {E} WHERE user_id < 0", "SELECT COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s FROM events WHERE user_id < 0")
# -- joins; the right side is filtered, as every key has a partner
_W = f"WITH c AS (SELECT c_custkey, c_name, c_acctbal FROM {C} WHERE c_acctbal > 3000) "
_WD = "WITH c AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 3000) "
for _kind in ("inner", "left", "right", "full"):
    _add(f"join_{_kind}", f"{_W}SELECT o_orderkey, c_name FROM {O} o {_kind.upper()} JOIN c ON o.o_custkey = c.c_custkey", f"{_WD}SELECT o_orderkey, c_name FROM orders o {_kind.upper()} JOIN c ON o.o_custkey = c.c_custkey")
for _kind, _in in (("semi", "IN"), ("anti", "NOT IN")):
    _add(f"join_{_kind}", f"{_W}SELECT o_orderkey FROM {O} o {_kind.upper()} JOIN c ON o_custkey = c_custkey", f"{_WD}SELECT o_orderkey FROM orders WHERE o_custkey {_in} (SELECT c_custkey FROM c)")
_add("join_cross", "SELECT n_name, r_name FROM 'nation.parquet' CROSS JOIN (SELECT r_name FROM 'region.parquet') r", "SELECT n_name, r_name FROM nation CROSS JOIN region")
_add("join_composite", f"WITH p AS (SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM {L} GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, n FROM {L} l JOIN p ON l.l_partkey = p.l_partkey AND l.l_suppkey = p.l_suppkey WHERE n > 1", "WITH p AS (SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, n FROM lineitem l JOIN p USING (l_partkey, l_suppkey) WHERE n > 1")
_add("join_chain", f"WITH c AS (SELECT c_custkey, c_nationkey FROM {C}), n AS (SELECT n_nationkey, n_name, n_regionkey FROM 'nation.parquet'), r AS (SELECT r_regionkey, r_name FROM 'region.parquet') SELECT r_name, n_name, COUNT(*) AS n FROM {O} JOIN c ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey JOIN r ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
     "SELECT r_name, n_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
_add("join_collision_names", f"WITH b AS (SELECT event_id, user_id, value FROM {E} WHERE value > 80) SELECT event_id, value, event_id_r, value_r FROM {E} a JOIN b ON a.event_id = b.event_id", "SELECT a.event_id, a.value, b.event_id AS event_id_r, b.value AS value_r FROM events a JOIN events b ON a.event_id = b.event_id WHERE b.value > 80")
# -- windows
_OV = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
for _f in ("ROW_NUMBER", "RANK", "DENSE_RANK"):
    _o = "OVER (PARTITION BY user_id ORDER BY event_type DESC)" if _f != "ROW_NUMBER" else _OV
    _add(f"win_{_f.lower()}", f"SELECT event_id, {_f}() {_o} AS r FROM {E}")
_add("win_lag", f"SELECT event_id, LAG(value) {_OV} AS p FROM {E}")
_add("win_lead", f"SELECT event_id, LEAD(value, 2) {_OV} AS p FROM {E}")
_add("win_total", f"SELECT event_id, COUNT(*) OVER (PARTITION BY event_type) AS n, MAX(user_id) OVER (PARTITION BY event_type) AS m FROM {E}")
_add("win_running", f"SELECT event_id, SUM(user_id) OVER (PARTITION BY event_type ORDER BY user_id) AS s FROM {E}", "SELECT event_id, CAST(SUM(user_id) OVER (PARTITION BY event_type ORDER BY user_id) AS BIGINT) AS s FROM events")
_add("win_rows_running", f"SELECT event_id, SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM {E}", "SELECT event_id, CAST(SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events")
_add("win_rows_moving", f"SELECT event_id, COUNT(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM {E}")
_add("win_minmaxavg", f"SELECT event_id, MIN(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS lo, MAX(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS hi, AVG(user_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS a FROM {E}")
_add("win_delta", f"SELECT event_id, user_id - before AS d FROM (SELECT event_id, user_id, LAG(user_id) OVER (ORDER BY event_id) AS before FROM {E}) m WHERE before IS NOT NULL", "SELECT event_id, user_id - before AS d FROM (SELECT event_id, user_id, LAG(user_id) OVER (ORDER BY event_id) AS before FROM events) m WHERE before IS NOT NULL")
# -- sorting, limits, sets, reshaping
_add("sort_nulls_last", f"SELECT event_id, k, ROW_NUMBER() OVER (ORDER BY k DESC, event_id) AS r FROM (SELECT event_id, NULLIF(event_type, 'click') AS k FROM {E}) t ORDER BY k DESC, event_id", "SELECT event_id, k, ROW_NUMBER() OVER (ORDER BY k DESC NULLS LAST, event_id) AS r FROM (SELECT event_id, NULLIF(event_type, 'click') AS k FROM events) t ORDER BY r")
_add("sort_hidden", f"SELECT event_id, ROW_NUMBER() OVER (ORDER BY value + user_id DESC, event_id) AS r FROM {E} ORDER BY value + user_id DESC, event_id", "SELECT event_id, ROW_NUMBER() OVER (ORDER BY value + user_id DESC, event_id) AS r FROM events ORDER BY r")
_add("topn_offset", f"SELECT o_orderkey, o_totalprice FROM {O} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
_add("limit_offset", f"SELECT COUNT(*) AS n FROM (SELECT event_id FROM {E} LIMIT 100 OFFSET 50) t", "SELECT COUNT(*) AS n FROM (SELECT event_id FROM events LIMIT 100 OFFSET 50) t")
_add("distinct_all", f"SELECT DISTINCT event_type, user_id % 4 AS k FROM {E}")
_add("distinct_on", f"SELECT DISTINCT ON (user_id) user_id, event_id FROM (SELECT user_id, event_id FROM {E} ORDER BY event_id) t", "SELECT user_id, MIN(event_id) AS event_id FROM events GROUP BY user_id")
_add("union_by_name_nullfill", f"SELECT event_id, value FROM {E} WHERE user_id < 50 UNION ALL BY NAME SELECT value, user_id FROM {E} WHERE user_id >= 50", "SELECT event_id, value FROM events WHERE user_id < 50 UNION ALL SELECT NULL, value FROM events WHERE user_id >= 50")
_add("union_by_name_widen", f"SELECT user_id AS x FROM {E} UNION ALL BY NAME SELECT value AS x FROM {E}", "SELECT CAST(user_id AS DOUBLE) AS x FROM events UNION ALL SELECT value FROM events")
_add("union_tagged", f"SELECT 'a' AS tag, t.* FROM 'nation.parquet' t UNION ALL BY NAME SELECT 'b' AS tag, t.* FROM 'nation.parquet' t", "SELECT 'a' AS tag, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation UNION ALL SELECT 'b', n_nationkey, n_name, n_regionkey FROM nation")
_add("explode_split", f"SELECT event_id, w FROM (SELECT event_id, event_type || ',' || user_id || ',,' || left(event_type, user_id % 5) AS parts FROM {E}) t CROSS JOIN UNNEST(SPLIT(parts, ',')) AS w", "SELECT event_id, unnest(string_split(event_type || ',' || user_id || ',,' || left(event_type, user_id % 5), ',')) AS w FROM events")
_add("cte", f"WITH a AS (SELECT user_id, COUNT(*) AS n FROM {E} GROUP BY user_id), b AS (SELECT user_id, n FROM a WHERE n > 5) SELECT COUNT(*) AS k, SUM(n) AS s FROM b", "WITH a AS (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id), b AS (SELECT user_id, n FROM a WHERE n > 5) SELECT COUNT(*) AS k, CAST(SUM(n) AS BIGINT) AS s FROM b")
_add("derived_table", f"SELECT k, MAX(n) AS m FROM (SELECT event_type AS k, user_id, COUNT(*) AS n FROM {E} GROUP BY 1, 2) x GROUP BY k", "SELECT k, MAX(n) AS m FROM (SELECT event_type AS k, user_id, COUNT(*) AS n FROM events GROUP BY 1, 2) x GROUP BY k")
_add("star_exclude", "SELECT * EXCLUDE (n_regionkey, nothing) FROM 'nation.parquet'", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
_add("star_rename", "SELECT * RENAME (n_name AS nation) FROM 'nation.parquet'", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS nation, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
_add("range_source", "SELECT range, range * range AS sq FROM RANGE(2, 50)", "SELECT range, range * range AS sq FROM range(2, 50)")
_add("unit_source", "SELECT 1 + 1 AS two, 'x' || 'y' AS t, 7 / 2 AS h", "SELECT 2::BIGINT AS two, 'xy' AS t, 3::BIGINT AS h")
_add("scalar_function", "CREATE FUNCTION net(p, d) AS p * (1 - d); " f"SELECT l_orderkey, l_linenumber, net(l_extendedprice, l_discount) AS n, LET t = l_tax + 1 IN t * t AS g FROM {L}", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice * (1 - l_discount) AS n, (l_tax + 1) * (l_tax + 1) AS g FROM lineitem")
_add("param_filter", f"PARAM least INT DEFAULT 90; PARAM kind STRING DEFAULT 'click'; SELECT event_id FROM {E} WHERE value > $least AND event_type = $kind", "SELECT event_id FROM events WHERE value > 90 AND event_type = 'click'")
_add("subquery_semi_scalar", f"SELECT event_id FROM {E} s CROSS JOIN (SELECT AVG(value) AS lim FROM {E}) a WHERE value > lim", "SELECT event_id FROM events WHERE value > (SELECT AVG(value) FROM events)")
# -- benchmark queries
_add("tpch_q01", f"SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order FROM {L} WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
_add("tpch_q03", f"WITH c AS (SELECT c_custkey FROM {C} WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey, o_custkey, o_orderdate FROM {O} WHERE o_orderdate < '1998-03-15') SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM {L} l JOIN o ON l.l_orderkey = o.o_orderkey SEMI JOIN c ON o_custkey = c_custkey WHERE l_shipdate > '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
     "SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1998-03-15' AND l_shipdate > '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
_add("tpch_q06", f"SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM {L} WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_add("tpch_q12_like", f"WITH o AS (SELECT o_orderkey, o_orderpriority FROM {O}) SELECT l_linestatus, SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, SUM(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low FROM {L} JOIN o ON l_orderkey = o_orderkey WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' GROUP BY l_linestatus",
     "SELECT l_linestatus, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(SUM(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' GROUP BY l_linestatus")
_add("tpch_q14", f"WITH p AS (SELECT p_partkey, p_type FROM {P}) SELECT ROUND(100.0 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo FROM {L} JOIN p ON l_partkey = p_partkey WHERE l_shipdate >= '1995-09-01' AND l_shipdate < '1995-10-01'",
     "SELECT ROUND(100.0::DOUBLE * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0::DOUBLE END) / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= '1995-09-01' AND l_shipdate < '1995-10-01'")
_add("ssb_q11_like", f"SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM {L} WHERE extract(year FROM l_shipdate) = 1997 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25", "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE extract(year FROM l_shipdate) = 1997 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25")
_add("ssb_q21_like", f"WITH p AS (SELECT p_partkey, p_brand FROM {P} WHERE p_type = 'PROMO'), s AS (SELECT s_suppkey, s_nationkey FROM 'supplier.parquet') SELECT extract(year FROM l_shipdate) AS y, p_brand, ROUND(SUM(l_extendedprice), 2) AS revenue FROM {L} JOIN p ON l_partkey = p_partkey JOIN s ON l_suppkey = s_suppkey WHERE s_nationkey < 12 GROUP BY y, p_brand ORDER BY y, p_brand",
     "SELECT extract(year FROM l_shipdate) AS y, p_brand, ROUND(SUM(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_type = 'PROMO' AND s_nationkey < 12 GROUP BY y, p_brand ORDER BY y, p_brand")
_add("ssb_q41_like", f"WITH o AS (SELECT o_orderkey, o_custkey FROM {O}), c AS (SELECT c_custkey, c_nationkey FROM {C}), n AS (SELECT n_nationkey, n_name, n_regionkey FROM 'nation.parquet'), s AS (SELECT s_suppkey FROM 'supplier.parquet') SELECT extract(year FROM l_shipdate) AS y, n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS profit FROM {L} JOIN o ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey SEMI JOIN s ON l_suppkey = s_suppkey WHERE n_regionkey = 1 GROUP BY y, n_name ORDER BY y, n_name",
     "SELECT extract(year FROM l_shipdate) AS y, n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS profit FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey WHERE n_regionkey = 1 GROUP BY y, n_name ORDER BY y, n_name")
