"""One case for each edge of the functions and casts."""

import datetime as dt
import math
import struct
from decimal import Decimal

import pytest

from millrace.errors import PlanError

CASES = {
    # integers and floats
    "7 / 2": 3, "-7 / 2": -3, "7 % -3": 1, "-7 % 3": -1, "mod(7, 0)": None, "7.5 / 0": math.inf, "-7.5 / 0": -math.inf, "-7.0 % 3": 2.0, "7.0 % -3": -2.0, "1 + 2 * 3": 7,
    "(1 + 2) * 3": 9, "6 & 3 | 8": 10, "5 ^ 1": 4, "1 << 63": -(1 << 63), "1 << 64": 0, "-8 >> 1": -4, "-8 >> 64": -1, "8 >> -1": 0, "~0": -1, "2 + 3 & 1": 1,
    # rounding
    "round(2.5)": 3.0, "round(-2.5)": -3.0, "round(15.0, -1)": 20.0, "round(7)": 7, "floor(-1.5)": -2.0, "ceil(1.2)": 2.0, "floor(3)": 3, "sign(-2.5)": -1, "abs(-4)": 4, "sqrt(-1.0)": None,
    "sqrt(9)": 3.0, "power(2, 10)": 1024.0, "floor(1e300)": 1e300,
    # text
    "upper('aé')": "Aé", "lower('AÉ')": "aÉ", "length('é')": 2, "trim(' \t\r\nx ')": "x", "substr('SD1010', 4, 2)": "01", "substr('abc', 0, 2)": "ab", "substr('abc', -2)": "abc", "substr('abc', 2, 0)": "",
    "substr('abc', 9)": "", "left('abc', 2)": "ab", "left('abc', -2)": "a", "left('abc', 0)": "", "left('abc', 99)": "abc", "right('abc', 2)": "bc", "right('abc', -2)": "c", "lpad('abc', 2)": "ab",
    "lpad('a', 3, 'xy')": "xya", "rpad('a', 0)": "", "lpad('a', 3, '')": "a", "split_part('a,b', ',', 2)": "b", "split_part('a,b', ',', 0)": "", "split_part('a,b', ',', 5)": "", "split_part('a', '', 1)": None,
    "strpos('éa', 'a')": 3, "strpos('a', '')": 1, "strpos('a', 'z')": 0, "repeat('ab', -1)": "", "reverse('abc')": "cba", "replace('abc', '', 'x')": "abc", "concat('a', 1, true)": "a1true", "'a' || NULL": None,
    "'x' || 1.0": "x1", "'x' || 1e21": "x1000000000000000000000", "'x' || 1.5e-7": "x0.00000015", "'x' || 123456789.5": "x123456789.5", "contains('abc', 'b')": True,
    # like: a backslash is itself
    r"'a\b' LIKE 'a\b'": True, r"'a%' LIKE 'a\%'": False, "'abc' LIKE 'a_c'": True, "'abc' NOT LIKE '%z%'": True,
    # regular expressions: first match, groups, the very end
    "regexp_replace('aaa', 'a', 'b')": "baa", r"regexp_replace('ab12', '([a-z]+)(\d+)', '\2-\1')": "12-ab", r"regexp_replace('abc', 'b', '[\0]')": "a[b]c", "regexp_replace('abc', 'z', 'x')": "abc",
    "regexp_replace('ab', 'a|b', '$1')": "$1b", r"regexp_replace('x1', '(\d)', '\17')": "x17", "regexp_replace('a', 'a$', 'b')": "b", "regexp_replace('b1', '^[a-c](?:1|2)', 'k')": "k",
    # dates
    "date_add('month', 1, CAST('2024-01-31' AS DATE))": dt.date(2024, 2, 29), "date_diff('year', CAST('2023-12-31' AS DATE), CAST('2024-01-01' AS DATE))": 1,
    "date_diff('month', CAST('2023-12-31' AS DATE), CAST('2024-01-01' AS DATE))": 1, "date_diff('day', CAST('2024-01-01 12:00:00' AS TIMESTAMP), CAST('2024-01-02 11:00:00' AS TIMESTAMP))": 0,
    "date_trunc('month', CAST('2024-05-17' AS DATE))": dt.datetime(2024, 5, 1), "extract(second FROM CAST('2024-01-01 00:00:07.9' AS TIMESTAMP))": 7, "epoch(CAST('1969-12-31 23:59:59.5' AS TIMESTAMP))": -1,
    "to_timestamp(86400)": dt.datetime(1970, 1, 2), "strftime(CAST('2024-03-05' AS DATE), 'it''s %d.%m.%y %%')": "it's 05.03.24 %", "make_date(2024, 2, 29)": dt.date(2024, 2, 29),
    # casts
    "CAST(' 12 ' AS INT)": 12, "CAST(1.7 AS INT)": 1, "TRY_CAST('1.7' AS INT)": None, "TRY_CAST('1000,00' AS FLOAT)": None, "CAST('1e3' AS FLOAT)": 1000.0, "CAST('1.239' AS DECIMAL(10,2))": Decimal("1.23"),
    "CAST('-1.239' AS DECIMAL(10,2))": Decimal("-1.23"), "TRY_CAST('1e3' AS DECIMAL(10,2))": None, "TRY_CAST('2024-5-7' AS DATE)": None, "TRY_CAST('2024-02-31' AS DATE)": None, "TRY_CAST('yes' AS BOOL)": None,
    "CAST('TRUE' AS BOOL)": True, "CAST(0 AS BOOL)": False, "CAST(CAST('2024-01-01T10:00:00.5' AS TIMESTAMP) AS STRING)": "2024-01-01 10:00:00.500000", "CAST(true AS STRING)": "true", "CAST(1.0 AS STRING)": "1",
    # nulls and choices
    "nullif(1, 1)": None, "nullif(1, NULL)": 1, "greatest(1, NULL, 3)": 3, "least(2, 1.5)": 1.5, "NULL ?? 4": 4, "IF(NULL, 1, 2)": 2, "CASE 3 WHEN 1, 3 THEN 'a' ELSE 'b' END": "a", "CASE NULL WHEN NULL THEN 1 END": None,
    "'' IS EMPTY": True, "NULL IS EMPTY": True, "'' IS NULL": False, "1 IN (2, NULL)": None, "1 NOT IN (2, 3)": True, "NOT NULL": None, "NULL AND false": False, "LET x = 2 IN x * x": 4,
    # bits
    "bit_count(-1)": 64, "to_hex(255)": "ff", "to_hex(-1)": "f" * 16, "from_hex('0xFF')": 255, "from_hex('ffffffffffffffff')": -1,
}

REFUSED = [
    "'a' = 1", "1 + 'a'", "upper(1, 2)", "nothing(1)", "CASE WHEN true THEN 1 ELSE 'a' END", "coalesce(1, 'a')", "date_add('hour', 1, CAST('2024-01-01' AS DATE))", "date_trunc('week', now())", "strftime(now(), '%j')",
    r"regexp_replace('a', '(?=a)', 'b')", r"regexp_replace('a', '(a)\1', 'b')", "now() > 'yesterday'", "1 IS EMPTY", "CAST(1 AS TIME)", "NOT 1", "'a' && 'b'", "sum(1) OVER () + 1", "x", "$missing", "(SELECT 1)", "EXISTS (SELECT 1)",
]
RAISES = ["1 / 0", "1 % 0", "CAST('a' AS INT)", "9223372036854775807 + 1", "from_hex('zz')", "make_date(2024, 2, 30)", "CAST('1.7' AS INT)"]


def test_values(rows):
    """All cases in one query, so that they run compiled together."""
    got = rows("SELECT " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(CASES)))[0]
    wrong = {e: (g, want) for (e, want), g in zip(CASES.items(), got, strict=True) if g != want or type(g) is not type(want) and want is not None}
    assert not wrong


@pytest.mark.parametrize("e", REFUSED)
def test_refused_while_planning(engine, e):
    with pytest.raises(PlanError):
        engine().check(f"SELECT {e} AS x")


@pytest.mark.parametrize("e", RAISES)
def test_raises_in_the_run(engine, e):
    df = engine().sql(f"SELECT {e} AS x")
    with pytest.raises(Exception):  # noqa: B017
        df.collect()


def test_nan_of_a_zero_divisor_is_the_plain_one(rows):
    """Bit by bit, as DuckDB and others show the sign of a NaN; over a file, so that nothing is folded while planning."""
    (rows.root / "f.csv").write_text("i,x,y\n1,0.0,0.0\n2,0.0,-0.0\n3,1.5,-0.0\n4,,0.0\n5,-2.5,0.0\n")
    found = [q for _, q in rows("SELECT i, x / y AS q FROM 'f.csv' ORDER BY i")]
    assert [struct.pack(">d", q).hex() for q in found[:2]] == ["7ff8000000000000"] * 2 and found[2:] == [-math.inf, None, -math.inf]


def test_nan_and_zero_group(rows):
    assert rows("SELECT COUNT(*) AS n FROM (SELECT DISTINCT x FROM (SELECT 0.0 AS x UNION ALL BY NAME SELECT -0.0 AS x UNION ALL BY NAME SELECT 0.0 / 0 AS x UNION ALL BY NAME SELECT 0.0 / 0 AS x) t) u") == [(2,)]
