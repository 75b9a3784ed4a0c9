"""Request bodies under a declared contract."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import RunError
from ..functions.casts import spark_type
from ..lang import ast as A

Columns = list[tuple[str, A.Type, bool]]


class Invalid(RunError):
    """The body breaks its contract; the request is to blame."""


def value(v: object, t: A.Type, where: str) -> object:
    try:
        if t.kind in ("string", "json"):
            return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        if t.kind == "bool":
            if isinstance(v, bool):
                return v
            return {"true": True, "false": False}[str(v).lower()]
        if t.kind == "int":
            if isinstance(v, bool) or isinstance(v, float) and v != int(v) or not -(1 << 63) <= int(v) < 1 << 63:
                raise ValueError
            return int(v)
        if t.kind == "float":
            if isinstance(v, bool):
                raise ValueError
            return float(v)
        if t.kind == "decimal":
            return decimal.Decimal(str(v)).quantize(decimal.Decimal(1).scaleb(-t.s), rounding=decimal.ROUND_DOWN)
        if t.kind == "date":
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(v)):
                raise ValueError
            return dt.date.fromisoformat(v)
        if t.kind == "timestamp":
            return dt.datetime.fromisoformat(str(v).removesuffix("Z"))
        if t.kind == "bytes":
            return str(v).encode()
    except (ValueError, KeyError, TypeError, decimal.InvalidOperation):
        pass
    raise Invalid(f"{where}: {v!r} is no {t}")


def validated(raw: bytes | str | list | dict, columns: Columns) -> list[tuple]:
    """A JSON object or array of them as rows; NOT NULL is enforced and further keys are dropped."""
    if isinstance(raw, (bytes, str)):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise Invalid(f"the body is no JSON: {e}") from e
    rows = [raw] if isinstance(raw, dict) else raw
    if not isinstance(rows, list):
        raise Invalid("the body is neither an object nor an array")
    out = []
    for i, row in enumerate(rows):
        if not isinstance(row, dict):
            raise Invalid(f"row {i}: not an object")
        made = []
        for name, kind, required in columns:
            v = row.get(name)
            if v is None and required:
                raise Invalid(f"row {i}: {name} must not be null")
            made.append(None if v is None else value(v, kind, f"row {i}: {name}"))
        out.append(tuple(made))
    return out


def schema(columns: Columns) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(spark_type(t)), True) for n, t, _ in columns])


def read(spark: SparkSession, raw: bytes | str | list | dict, columns: Columns) -> DataFrame:
    return spark.createDataFrame(validated(raw, columns), schema(columns))
