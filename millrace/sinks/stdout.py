"""Results for people, and as one JSON object a line."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import text
from ..lang import ast as A


def _texts(df: DataFrame, types: dict[str, A.Type]) -> DataFrame:
    col = lambda n: F.col("`" + n.replace("`", "``") + "`")
    return df.select(*[(text(col(n), t) if t.kind not in ("unknown", "bytes") else col(n).cast("string") if t.kind == "unknown" else F.base64(col(n))).alias(n) for n, t in types.items()])


def table(df: DataFrame, types: dict[str, A.Type], most: int = 1000) -> str:
    """An aligned table of the first rows; numbers to the right."""
    names = list(types)
    got = _texts(df, types).limit(most + 1).collect()
    rows = [["" if v is None else str(v).replace("\n", "\\n") for v in r] for r in got[:most]]
    widths = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    right = [t.kind in ("int", "float", "decimal") for t in types.values()]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, widths, right, strict=True)).rstrip()
    more = [f"... more than {most} rows"] if len(got) > most else []
    return "\n".join([line(names), "  ".join("-" * w for w in widths), *map(line, rows), *more])


def ndjson(df: DataFrame, types: dict[str, A.Type]) -> Iterator[str]:
    """Rows as JSON objects: decimals and dates as text, bytes in base64."""
    exact = {n for n, t in types.items() if t.kind in ("bool", "int", "float")}
    keep = df.select(*[(F.col("`" + n.replace("`", "``") + "`")).alias(n) for n in types])
    other = _texts(keep, types)
    mixed = keep.select(*[F.col("`" + n.replace("`", "``") + "`") for n in types]) if exact == set(types) else other
    for r in mixed.toLocalIterator(prefetchPartitions=True):
        out = {}
        for n, v in zip(types, r, strict=True):
            k = types[n].kind
            if v is not None and n in exact and isinstance(v, str):
                v = v == "true" if k == "bool" else int(v) if k == "int" else float(v)
            if isinstance(v, float) and v != v or v in (float("inf"), float("-inf")):
                v = None
            out[n] = base64.b64encode(v).decode() if isinstance(v, (bytes, bytearray)) else v
        yield json.dumps(out, ensure_ascii=False, separators=(",", ":"))
