"""Casts and text rendering: strict where Spark is lenient, truncating where Spark rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from ..lang import ast as A

_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|nan|infinity)$"
_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_STAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:.([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?))?$"


def spark_type(t: A.Type) -> str:
    return {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "bytes": "binary", "date": "date", "time": "bigint", "timestamp": "timestamp_ntz", "unknown": "void", "json": "string"}.get(t.kind) or f"decimal({t.p},{t.s})"


def float_text(c: Column) -> Column:
    """A double as its shortest digits, without exponent and without a bare ``.0``."""
    s = c.cast("string")
    # Only the common case is generated code: with exponents and infinities in it a wide row's method is too large to be compiled.
    odd = F.element_at(F.transform(F.array(s), _odd_float), 1)
    return F.when(s.contains("E") | s.contains("n") | s.contains("N"), odd).when(s.endswith(".0"), F.substr(s, F.lit(1), F.length(s) - 2)).otherwise(s)


def _odd_float(s: Column) -> Column:
    """The text of a double that Java writes with an exponent or as a word."""
    sign = F.when(s.startswith("-"), "-").otherwise("")
    whole, part = F.regexp_extract(s, r"([0-9]+)\.", 1), F.regexp_replace(F.regexp_extract(s, r"\.([0-9]+)", 1), "^0$", "")
    e = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int")
    large = F.when(F.length(part) <= e, F.concat(whole, part, F.repeat(F.lit("0"), e - F.length(part)))).otherwise(F.concat(whole, F.substr(part, F.lit(1), e), F.lit("."), F.substr(part, e + 1)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), whole, part)
    return F.when(s == "NaN", "nan").when(s.contains("n"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, F.when(e >= 0, large).otherwise(small)))


def text(c: Column, t: A.Type) -> Column:
    """Any value as it is written to text sinks."""
    if t.kind == "string":
        return c
    if t.kind == "float":
        return float_text(c)
    if t.kind == "timestamp":
        s = c.cast("string")
        return F.when(s.contains("."), F.rpad(s, F.instr(s, ".") + 6, F.lit("0"))).otherwise(s)
    if t.kind == "time":
        s = F.pmod(c, F.lit(1_000_000))
        seconds = F.floor(c / 1_000_000)
        clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.pmod(F.floor(seconds / 60), F.lit(60)), F.pmod(seconds, F.lit(60)))
        return F.when(s == 0, clock).otherwise(F.concat(clock, F.format_string(".%06d", s)))
    return c.cast("string")


def cut(c: Column, p: int, s: int) -> Column:
    """A decimal at scale ``s``, further digits dropped."""
    wide = c.cast(f"decimal(38,{min(38 - max(p - s, 1), max(s, 18))})")
    return F.when(wide >= 0, F.floor(wide, F.lit(s))).otherwise(F.ceil(wide, F.lit(s))).cast(f"decimal({p},{s})")


def cast(c: Column, have: A.Type, want: A.Type, safe: bool) -> Column:
    """CAST, or TRY_CAST where ``safe``: what does not convert is an error, or null."""
    h, w = have.kind, want.kind
    if h == "unknown":
        return c.cast(spark_type(want))
    if h == w and w != "decimal":
        return c
    bad = F.lit(None) if safe else F.raise_error(F.concat(F.lit(f"cannot cast to {want}: "), F.coalesce(text(c, have), F.lit("null"))))
    to = (lambda x: x.try_cast(spark_type(want))) if safe else (lambda x: x.cast(spark_type(want)))
    # A null stays null without a look at the pattern.
    guard = lambda x, pattern, made: F.when(x.isNull(), F.lit(None).cast(spark_type(want))).when(x.rlike(pattern), made).otherwise(bad.cast(spark_type(want)))
    if h == "string":
        x = F.trim(c, F.lit(" \t\r\n"))
    if w == "string":
        return text(c, have)
    if w == "int":
        if h == "string":
            return guard(x, _INT, to(x))
        if h in ("float", "bool", "decimal"):
            return to(c)
    if w == "float":
        if h == "string":
            return guard(F.lower(x), _FLOAT, to(x))
        if h in ("int", "decimal"):
            return to(c)
    if w == "decimal":
        if h == "string":
            return guard(x, _DECIMAL, cut(x, want.p, want.s))
        if h == "decimal":
            return cut(c, want.p, want.s)
        if h in ("int", "float"):
            return to(c)
        if h == "bool":
            return to(c.cast("int"))
    if w == "date":
        if h == "timestamp":
            return c.cast("date")
        if h == "string":
            return guard(c, _DATE, to(c))
    if w == "timestamp":
        if h == "date":
            return c.cast("timestamp_ntz")
        if h == "string":
            clock = F.regexp_extract(c, _STAMP, 2)
            full = F.concat(F.regexp_extract(c, _STAMP, 1), F.when(clock != "", F.concat(F.lit(" "), clock)).otherwise(F.lit("")))
            return guard(c, _STAMP, to(full))
    if w == "bool":
        if h == "int":
            return c != 0
        if h == "string":
            return guard(F.lower(c), "^(true|false)$", F.lower(c) == "true")
    raise PlanError(f"cannot cast {have} to {want}")
