"""Expressions of the syntax tree as typed columns. What does not type-check is refused here, before anything runs."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions import library as L
from ..functions.casts import cast, spark_type, text
from ..lang import ast as A

Scope = Mapping[str, A.Type]
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
_STAMP = re.compile(r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?\Z")
_INF, _NAN = float("inf"), float("nan")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def literal(value: object, t: A.Type) -> Column:
    if t.kind == "unknown" or value is None:
        return F.lit(None) if t.kind == "unknown" else F.lit(None).cast(spark_type(t))
    if t.kind == "int":
        if not -(1 << 63) <= value < 1 << 63:
            raise PlanError(f"{value} is no 64-bit integer")
        return F.lit(value).cast("bigint")
    if t.kind in ("date", "timestamp", "decimal", "float"):
        return F.lit(value if t.kind == "float" else str(value)).cast(spark_type(t))
    return F.lit(value)


def compile_expr(e: A.Expr, scope: Scope) -> L.Typed:
    if isinstance(e, A.Lit):
        return literal(e.value, e.type), e.type
    if isinstance(e, A.Col):
        if e.name not in scope:
            raise PlanError(f"unknown field {e.name!r}")
        return column(e.name), scope[e.name]
    if isinstance(e, A.Param):
        raise PlanError(f"${e.path} is not defined")
    if isinstance(e, A.Un):
        return _unary(e, scope)
    if isinstance(e, A.Bin):
        return _binary(e, scope)
    if isinstance(e, A.Is):
        c, t = compile_expr(e.arg, scope)
        if e.what == "empty" and t.kind not in ("string", "unknown"):
            raise PlanError(f"IS EMPTY is for text, not {t}")
        hit = c.isNull() if e.what == "null" or t.kind == "unknown" else c.isNull() | (c == "")
        return (~hit if e.negated else hit), A.BOOL
    if isinstance(e, A.In):
        return _in(e, scope)
    if isinstance(e, A.Case):
        return _case(e, scope)
    if isinstance(e, A.Cast):
        c, t = compile_expr(e.arg, scope)
        if e.type.kind in ("time", "bytes", "json") and e.type != t:
            raise PlanError(f"cannot cast to {e.type}")
        return cast(c, t, e.type, e.safe), e.type
    if isinstance(e, A.Call):
        return _call(e, scope)
    if isinstance(e, A.Window):
        raise PlanError("a window function must be a whole select item")
    raise PlanError(f"{type(e).__name__} is not a value")


def boolean(e: A.Expr, scope: Scope, what: str) -> Column:
    c, t = compile_expr(e, scope)
    if t.kind not in ("bool", "unknown"):
        raise PlanError(f"{what} needs a condition, not {t}")
    return c if t.kind == "bool" else c.cast("boolean")


def _unary(e: A.Un, scope: Scope) -> L.Typed:
    if e.op == "not":
        return ~boolean(e.arg, scope, "NOT"), A.BOOL
    c, t = compile_expr(e.arg, scope)
    if e.op == "~":
        return F.bitwise_not(L.need((c, t), "int", name="~")), A.INT
    return F.negative(L.need((c, t), *L.NUMERIC, name="-")), t


def _temporal_literal(e: A.Expr, t: A.Type, other: A.Type) -> L.Typed | None:
    """An ISO text literal beside a date or timestamp, as one."""
    if isinstance(e, A.Lit) and t.kind == "string" and other.kind in ("date", "timestamp"):
        pattern = _DATE if other.kind == "date" and _DATE.match(e.value) else _STAMP
        if not pattern.match(e.value):
            raise PlanError(f"{e.value!r} is no {other}")
        kind = A.DATE if pattern is _DATE else A.TIMESTAMP
        return F.lit(e.value.replace("T", " ")).cast(spark_type(kind)), kind
    return None


def comparable(a: A.Expr, b: A.Expr, scope: Scope) -> tuple[Column, Column]:
    x, y = compile_expr(a, scope), compile_expr(b, scope)
    x, y = _temporal_literal(a, x[1], y[1]) or x, _temporal_literal(b, y[1], x[1]) or y
    if "unknown" in (x[1].kind, y[1].kind) or x[1].kind in L.NUMERIC and y[1].kind in L.NUMERIC:
        return x[0], y[0]
    if x[1].kind == y[1].kind:
        return x[0], y[0]
    if {x[1].kind, y[1].kind} == {"date", "timestamp"}:
        return x[0].cast("timestamp_ntz"), y[0].cast("timestamp_ntz")
    raise PlanError(f"cannot compare {x[1]} with {y[1]}")


_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _binary(e: A.Bin, scope: Scope) -> L.Typed:
    if e.op in ("and", "or"):
        a, b = boolean(e.left, scope, e.op.upper()), boolean(e.right, scope, e.op.upper())
        return (a & b if e.op == "and" else a | b), A.BOOL
    if e.op in _COMPARE:
        return _COMPARE[e.op](*comparable(e.left, e.right, scope)), A.BOOL
    x, y = compile_expr(e.left, scope), compile_expr(e.right, scope)
    if e.op in ("&", "|", "^", "<<", ">>"):
        a, b = L.need(x, "int", name=e.op), L.need(y, "int", name=e.op)
        if e.op in "&|^":
            return {"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[e.op](b), A.INT
        wide = (b < 0) | (b >= 64)
        beyond = F.lit(0).cast("bigint") if e.op == "<<" else F.when(a < 0, F.lit(-1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        shifted = F.call_function("shiftleft" if e.op == "<<" else "shiftright", a, F.pmod(b, F.lit(64)).cast("int"))
        return F.when(wide & a.isNotNull(), beyond).otherwise(shifted), A.INT
    for t in (x[1], y[1]):
        if t.kind not in (*L.NUMERIC, "unknown"):
            raise PlanError(f"{e.op} does not take {t}")
    if {x[1].kind, y[1].kind} <= {"int", "unknown"}:
        a, b = (c.cast("bigint") if t.kind == "unknown" else c for c, t in (x, y))
        if e.op == "/":
            return F.call_function("div", a, b), A.INT
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b}[e.op](), A.INT
    a, b = L.as_float(x), L.as_float(y)
    if e.op in "+-*":
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[e.op](), A.FLOAT
    if e.op == "/":
        if isinstance(e.right, A.Lit) and e.right.value:
            return a / b, A.FLOAT
        # The processor's NaN of 0 * inf has its sign bit set and reads -nan elsewhere: the plain one takes its place.
        beyond = a * F.when(b.cast("string").startswith("-"), F.lit(-_INF)).otherwise(F.lit(_INF))
        return F.when(b == 0, F.nanvl(beyond, F.lit(_NAN))).otherwise(a / b), A.FLOAT
    r = a % b
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(_NAN))).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r), A.FLOAT


def _in(e: A.In, scope: Scope) -> L.Typed:
    pairs = [comparable(e.arg, i, scope) for i in e.items]
    literals = all(isinstance(i, A.Lit) and i.value is not None for i in e.items)
    first = pairs[0][0]
    kinds = {compile_expr(i, scope)[1].kind for i in e.items}
    if literals and len(kinds) == 1:
        hit = first.isin([b for _, b in pairs])
    else:
        hit = pairs[0][0] == pairs[0][1]
        for a, b in pairs[1:]:
            hit = hit | (a == b)
    return (~hit if e.negated else hit), A.BOOL


def _case(e: A.Case, scope: Scope) -> L.Typed:
    results = [compile_expr(r, scope) for _, r in e.whens] + ([compile_expr(e.other, scope)] if e.other is not None else [])
    t = results[0][1]
    for _, r in results[1:]:
        t = L.widen(t, r, "results of CASE")
    out: Column | None = None
    for (tests, _), (made, have) in zip(e.whens, results, strict=False):
        each = [boolean(x, scope, "WHEN") if e.subject is None else _COMPARE["="](*comparable(e.subject, x, scope)) for x in tests]
        hit = each[0]
        for x in each[1:]:
            hit = hit | x
        made = L.coerced(made, have, t)
        out = F.when(hit, made) if out is None else out.when(hit, made)
    if e.other is not None:
        out = out.otherwise(L.coerced(*results[-1], t))
    return out, t


def _call(e: A.Call, scope: Scope) -> L.Typed:
    name, args = e.name, e.args
    value = lambda i: args[i].value if i < len(args) and isinstance(args[i], A.Lit) else None
    if name == "if":
        if len(args) != 3:
            raise PlanError("if takes a condition and two values")
        return _case(A.Case(None, (((args[0],), args[1]),), args[2]), scope)
    if name == "like":
        if len(args) != 2:
            raise PlanError("like takes a text and a pattern")
        c, p = (L.need(compile_expr(a, scope), "string", name="LIKE") for a in args)
        return L.like(c, value(1) if isinstance(value(1), str) else p), A.BOOL
    if name == "regexp_replace":
        if len(args) != 3:
            raise PlanError("regexp_replace takes three arguments")
        return L.regexp_replace(compile_expr(args[0], scope), value(1), value(2))
    if name in ("date_trunc", "extract", "date_add", "date_diff"):
        n = {"date_trunc": 2, "extract": 2, "date_add": 3, "date_diff": 3}[name]
        if len(args) != n:
            raise PlanError(f"{name} takes {n} arguments")
        unit = L._unit(None, value(0), name)
        rest = [compile_expr(a, scope) for a in args[1:]]
        if name == "date_add":
            rest[1] = _temporal_literal(args[2], rest[1][1], A.TIMESTAMP) or rest[1]
        else:
            rest = [_temporal_literal(a, r[1], A.TIMESTAMP) or r for a, r in zip(args[1:], rest, strict=True)]
        return {"date_trunc": L.date_trunc, "extract": L.extract, "date_add": L.date_add, "date_diff": L.date_diff}[name](unit, *rest)
    if name == "strftime":
        if len(args) != 2:
            raise PlanError("strftime takes a value and a format")
        return L.strftime(compile_expr(args[0], scope), value(1))
    if name in ("count", "sum", "avg", "min", "max"):
        raise PlanError(f"{name.upper()} is an aggregate and cannot stand here")
    f = L.FUNCTIONS.get(name)
    if f is None:
        raise PlanError(f"unknown function {name}")
    if not f.least <= len(args) <= f.most:
        raise PlanError(f"{name} takes {f.least if f.least == f.most else f'{f.least} to {f.most}'} arguments, not {len(args)}")
    return f.make(*[compile_expr(a, scope) for a in args])


__all__ = ["boolean", "column", "compile_expr", "quoted", "text"]
