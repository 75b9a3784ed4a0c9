"""The scalar functions: for each a check of its arguments' types, its result's type, and its column.

Texts are measured in bytes where that shows, letters change case in ASCII only, and edge cases are pinned down with
CASE expressions, so that everything stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from ..lang import ast as A
from .casts import spark_type, text
from .patterns import first_match

Typed = tuple[Column, A.Type]
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NUMERIC = ("int", "float", "decimal")
UNITS = ("year", "month", "day", "hour", "minute", "second")
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy"}


@dataclass(frozen=True)
class Fn:
    least: int
    most: int
    make: Callable[..., Typed]


def widen(a: A.Type, b: A.Type, what: str = "values") -> A.Type:
    """The one type of two; only int widens, to float or decimal."""
    if a.kind == "unknown":
        return b
    if b.kind == "unknown" or a == b:
        return a
    if a.kind == b.kind == "decimal":
        s = max(a.s, b.s)
        return A.Type("decimal", min(38, max(a.p - a.s, b.p - b.s) + s), s)
    kinds = {a.kind, b.kind}
    if kinds == {"int", "float"}:
        return A.FLOAT
    if kinds == {"int", "decimal"}:
        return a if a.kind == "decimal" else b
    if a.kind == b.kind:
        return a
    raise PlanError(f"{what} of types {a} and {b} do not go together")


def coerced(c: Column, have: A.Type, want: A.Type) -> Column:
    return c if have == want else c.cast(spark_type(want))


def as_float(x: Typed) -> Column:
    return x[0] if x[1].kind == "float" else x[0].cast("double")


def need(x: Typed, *kinds: str, name: str) -> Column:
    if x[1].kind not in (*kinds, "unknown"):
        raise PlanError(f"{name} does not take {x[1]}")
    return x[0] if x[1].kind != "unknown" else x[0].cast(spark_type(A.Type(kinds[0])))


def _binary(c: Column) -> Column:
    return c.cast("binary")


def byte_substr(c: Column, start: Column, length: Column | None = None) -> Column:
    raw = _binary(c)
    start = F.greatest(start.cast("int"), F.lit(1))
    part = F.substring(raw, start, F.greatest(length.cast("int"), F.lit(0))) if length is not None else F.substring(raw, start, F.octet_length(c))
    return part.cast("string")


def _case(a: str, b: str):
    def make(x: Typed) -> Typed:
        return F.translate(text(*x) if x[1].kind != "unknown" else x[0].cast("string"), a, b), A.STRING

    return make


def _string(name: str, result: A.Type, f: Callable[..., Column]):
    def make(*xs: Typed) -> Typed:
        return f(*[need(x, "string", name=name) for x in xs]), result

    return make


def _length(x: Typed) -> Typed:
    return (F.octet_length(x[0]) if x[1].kind == "bytes" else F.octet_length(text(*x))).cast("bigint"), A.INT


def _substr(s: Typed, start: Typed, length: Typed | None = None) -> Typed:
    return byte_substr(need(s, "string", name="substr"), need(start, "int", name="substr"), need(length, "int", name="substr") if length else None), A.STRING


def _side(left: bool):
    def make(s: Typed, n: Typed) -> Typed:
        c, k = need(s, "string", name="left/right"), need(n, "int", name="left/right")
        size = F.octet_length(c)
        keep = F.least(F.when(k >= 0, k).otherwise(F.greatest(size + k, F.lit(0))), size)
        return byte_substr(c, F.lit(1) if left else size - keep + 1, keep), A.STRING

    return make


def _pad(left: bool):
    def make(s: Typed, n: Typed, fill: Typed | None = None) -> Typed:
        c, k = need(s, "string", name="lpad/rpad"), need(n, "int", name="lpad/rpad").cast("int")
        f = need(fill, "string", name="lpad/rpad") if fill else F.lit(" ")
        made = (F.lpad if left else F.rpad)(_binary(c), k, _binary(f)).cast("string")
        kept = byte_substr(c, F.lit(1), k)
        return F.when(k <= 0, F.when(c.isNotNull() & f.isNotNull(), "")).when((f == "") & (F.octet_length(c) <= k), c).when(f == "", kept).otherwise(made), A.STRING

    return make


def _concat(*xs: Typed) -> Typed:
    return F.concat(*[text(*x) if x[1].kind != "unknown" else x[0].cast("string") for x in xs]), A.STRING


def _unified(name: str, f: Callable[..., Column]):
    def make(*xs: Typed) -> Typed:
        t = xs[0][1]
        for x in xs[1:]:
            t = widen(t, x[1], f"arguments of {name}")
        return f(*[coerced(*x, t) for x in xs]), t

    return make


def _nullif(a: Typed, b: Typed) -> Typed:
    t = widen(a[1], b[1], "arguments of nullif")
    return F.when(coerced(*a, t) == coerced(*b, t), F.lit(None)).otherwise(a[0]), a[1]


def _split_part(s: Typed, d: Typed, n: Typed) -> Typed:
    c, sep, k = need(s, "string", name="split_part"), need(d, "string", name="split_part"), need(n, "int", name="split_part").cast("int")
    any_null = c.isNull() | sep.isNull() | k.isNull()
    # The divisor 1 stands in for parts that the CASE has answered already.
    return F.when(any_null | (sep == ""), F.lit(None).cast("string")).when(k < 1, "").otherwise(F.split_part(c, sep, F.greatest(k, F.lit(1)))), A.STRING


def _abs(x: Typed) -> Typed:
    return F.abs(need(x, *NUMERIC, name="abs")), x[1]


def _whole(f: Callable[[Column], Column]):
    def make(x: Typed) -> Typed:
        if x[1].kind == "int":
            return x
        c = as_float((need(x, *NUMERIC, name="floor/ceil"), x[1]))
        # Doubles of 2^52 and more, infinities and NaN are whole as they are, and need not fit a long.
        return F.when(F.abs(c) < float(1 << 52), f(c).cast("double")).otherwise(c), A.FLOAT

    return make


def _round(x: Typed, n: Typed | None = None) -> Typed:
    if n is None and x[1].kind == "int":
        return x
    c = as_float((need(x, *NUMERIC, name="round"), x[1]))
    if n is None:
        return F.round(c, 0), A.FLOAT
    return F.round(c, need(n, "int", name="round").cast("int")), A.FLOAT


def _mod(a: Typed, b: Typed) -> Typed:
    return F.try_mod(need(a, "int", name="mod"), need(b, "int", name="mod")), A.INT


def _power(a: Typed, b: Typed) -> Typed:
    return F.pow(as_float((need(a, *NUMERIC, name="power"), a[1])), as_float((need(b, *NUMERIC, name="power"), b[1]))), A.FLOAT


def _sqrt(x: Typed) -> Typed:
    c = as_float((need(x, *NUMERIC, name="sqrt"), x[1]))
    return F.when((c >= 0) | F.isnan(c), F.sqrt(c)), A.FLOAT


def _sign(x: Typed) -> Typed:
    return F.signum(as_float((need(x, *NUMERIC, name="sign"), x[1]))).cast("bigint"), A.INT


def _unit(u: Typed, literal: object, name: str) -> str:
    if not isinstance(literal, str) or literal.lower() not in UNITS:
        raise PlanError(f"{name} takes a unit: {', '.join(UNITS)}")
    return literal.lower()


def temporal(x: Typed, name: str) -> Typed:
    if x[1].kind not in ("date", "timestamp", "unknown"):
        raise PlanError(f"{name} takes a date or timestamp, not {x[1]}")
    return (x[0].cast("timestamp_ntz"), A.TIMESTAMP) if x[1].kind == "unknown" else x


def date_trunc(unit: str, x: Typed) -> Typed:
    c, _ = temporal(x, "date_trunc")
    return F.date_trunc(unit, c.cast("timestamp_ntz")).cast("timestamp_ntz"), A.TIMESTAMP


def extract(unit: str, x: Typed) -> Typed:
    c, t = temporal(x, "extract")
    if unit in ("hour", "minute", "second") and t.kind == "date":
        return F.when(c.isNotNull(), F.lit(0).cast("bigint")), A.INT
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[unit](c).cast("bigint"), A.INT


def date_add(unit: str, n: Typed, x: Typed) -> Typed:
    k = need(n, "int", name="date_add").cast("int")
    c, t = temporal(x, "date_add")
    if t.kind == "date":
        if unit in ("hour", "minute", "second"):
            raise PlanError(f"date_add of a {unit} needs a timestamp, not a date")
        return (F.date_add(c, k) if unit == "day" else F.add_months(c, k * (12 if unit == "year" else 1))), t
    return F.timestamp_add(unit.upper(), k, c).cast("timestamp_ntz"), A.TIMESTAMP


def date_diff(unit: str, a: Typed, b: Typed) -> Typed:
    x, y = (temporal(t, "date_diff")[0].cast("timestamp_ntz") for t in (a, b))
    years = F.year(y) - F.year(x)
    if unit == "year":
        return years.cast("bigint"), A.INT
    if unit == "month":
        return (years * 12 + F.month(y) - F.month(x)).cast("bigint"), A.INT
    return F.timestamp_diff(unit.upper(), x, y), A.INT


def strftime(x: Typed, pattern: object) -> Typed:
    c, _ = temporal(x, "strftime")
    if not isinstance(pattern, str):
        raise PlanError("strftime takes a literal format")
    # Runs of literal text are quoted as one, or two quotes in a row would read as an escaped one.
    parts: list[tuple[bool, str]] = []
    i = 0
    while i < len(pattern):
        code, kind = pattern[i], False
        if code == "%":
            i += 1
            code = pattern[i : i + 1]
            if code != "%":
                if code not in _STRFTIME or not code:
                    raise PlanError(f"strftime does not know %{code}")
                code, kind = _STRFTIME[code], True
        if parts and not kind and not parts[-1][0]:
            parts[-1] = (False, parts[-1][1] + code)
        else:
            parts.append((kind, code))
        i += 1
    out = "".join(x if kind else "'" + x.replace("'", "''") + "'" for kind, x in parts)
    if not out:
        return F.when(c.isNotNull(), ""), A.STRING
    return F.date_format(c, out), A.STRING


def _epoch(x: Typed) -> Typed:
    c, _ = temporal(x, "epoch")
    # Without a zone the clock's own time counts, so whole seconds are taken from the calendar.
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", c.cast("timestamp_ntz")).cast("timestamp_ntz")), A.INT


def _to_timestamp(x: Typed) -> Typed:
    n = need(x, *NUMERIC, name="to_timestamp").cast("bigint")
    days, rest = F.floor(n / 86400).cast("int"), F.pmod(n, F.lit(86400))
    return F.timestamp_add("SECOND", rest.cast("int"), F.date_add(F.lit("1970-01-01").cast("date"), days).cast("timestamp_ntz")).cast("timestamp_ntz"), A.TIMESTAMP


def _to_hex(x: Typed) -> Typed:
    return F.lower(F.hex(need(x, "int", name="to_hex"))), A.STRING


def _from_hex(x: Typed) -> Typed:
    c = need(x, "string", name="from_hex")
    bare = F.regexp_replace(c, "^0[xX]", "")
    bad = F.raise_error(F.concat(F.lit("from_hex: "), c)).cast("bigint")
    return F.when(c.isNull(), F.lit(None).cast("bigint")).when(bare.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(bare, 16, -10).cast("bigint")).otherwise(bad), A.INT


def like(c: Column, pattern: Column | str) -> Column:
    """``%`` any run, ``_`` one character; there is no escape character."""
    if isinstance(pattern, str):
        return c.like(pattern.replace("\\", "\\\\"))
    return F.like(c, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))


def regexp_replace(s: Typed, pattern: object, replacement: object) -> Typed:
    c = need(s, "string", name="regexp_replace")
    if not isinstance(pattern, str) or not isinstance(replacement, str):
        raise PlanError("regexp_replace takes a literal pattern and replacement")
    return first_match(c, pattern, replacement), A.STRING


FUNCTIONS: dict[str, Fn] = {
    "now": Fn(0, 0, lambda: (F.localtimestamp(), A.TIMESTAMP)),
    "today": Fn(0, 0, lambda: (F.current_date(), A.DATE)),
    "lower": Fn(1, 1, _case(_UP, _LOW)),
    "upper": Fn(1, 1, _case(_LOW, _UP)),
    "length": Fn(1, 1, _length),
    "strlen": Fn(1, 1, _length),
    "trim": Fn(1, 1, _string("trim", A.STRING, lambda c: F.trim(c, F.lit(" \t\r\n")))),
    "substr": Fn(2, 3, _substr),
    "replace": Fn(3, 3, _string("replace", A.STRING, F.replace)),
    "concat": Fn(1, 999, _concat),
    "coalesce": Fn(1, 999, _unified("coalesce", F.coalesce)),
    "starts_with": Fn(2, 2, _string("starts_with", A.BOOL, F.startswith)),
    "ends_with": Fn(2, 2, _string("ends_with", A.BOOL, F.endswith)),
    "contains": Fn(2, 2, _string("contains", A.BOOL, F.contains)),
    "abs": Fn(1, 1, _abs),
    "floor": Fn(1, 1, _whole(F.floor)),
    "ceil": Fn(1, 1, _whole(F.ceil)),
    "round": Fn(1, 2, _round),
    "mod": Fn(2, 2, _mod),
    "power": Fn(2, 2, _power),
    "sqrt": Fn(1, 1, _sqrt),
    "sign": Fn(1, 1, _sign),
    "nullif": Fn(2, 2, _nullif),
    "greatest": Fn(2, 999, _unified("greatest", F.greatest)),
    "least": Fn(2, 999, _unified("least", F.least)),
    "lpad": Fn(2, 3, _pad(True)),
    "rpad": Fn(2, 3, _pad(False)),
    "left": Fn(2, 2, _side(True)),
    "right": Fn(2, 2, _side(False)),
    "split_part": Fn(3, 3, _split_part),
    "strpos": Fn(2, 2, _string("strpos", A.INT, lambda c, s: F.when(F.instr(c, s) > 0, F.octet_length(F.substr(c, F.lit(1), F.instr(c, s) - 1)) + 1).otherwise(F.instr(c, s)).cast("bigint"))),
    "repeat": Fn(2, 2, lambda s, n: (F.repeat(need(s, "string", name="repeat"), F.greatest(need(n, "int", name="repeat"), F.lit(0)).cast("int")), A.STRING)),
    "reverse": Fn(1, 1, _string("reverse", A.STRING, F.reverse)),
    "make_date": Fn(3, 3, lambda y, m, d: (F.make_date(*[need(x, "int", name="make_date").cast("int") for x in (y, m, d)]), A.DATE)),
    "epoch": Fn(1, 1, _epoch),
    "to_timestamp": Fn(1, 1, _to_timestamp),
    "bit_count": Fn(1, 1, lambda x: (F.bit_count(need(x, "int", name="bit_count")).cast("bigint"), A.INT)),
    "to_hex": Fn(1, 1, _to_hex),
    "from_hex": Fn(1, 1, _from_hex),
}
