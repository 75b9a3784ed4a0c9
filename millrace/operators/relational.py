"""The operators that need more than one DataFrame call to get the dialect's semantics."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.casts import spark_type
from ..functions.library import widen
from ..lang import ast as A

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ordering(c: Column, descending: bool) -> Column:
    """Nulls come last, either way."""
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def hidden(taken: list[str] | set[str], base: str) -> str:
    name, i = f"__{base}", 2
    while name in taken:
        name, i = f"__{base}{i}", i + 1
    return name


def joined_names(left: list[str], right: list[str]) -> dict[str, str]:
    """What a join's right columns are called: a name that the left has already gets ``_r``, ``_r2``, ..."""
    taken, out = set(left), {}
    for name in right:
        new, i = name, 1
        while new in taken:
            new, i = f"{name}_r" if i == 1 else f"{name}_r{i}", i + 1
        taken.add(new)
        out[name] = new
    return out


def join(left: DataFrame, right: DataFrame, kind: str, keys: list[tuple[Column, Column]], renamed: dict[str, str]) -> DataFrame:
    """An equi-join; ``keys`` are columns of the left frame and of the right one under its old names.

    The right side gets hidden names first, so that no key is ambiguous. How the rows meet is Spark's choice: by size it
    broadcasts, or sorts and merges with skewed partitions split.
    """
    inner = {n: f"__j{i}" for i, n in enumerate(right.columns)}
    moved = right.select(*[col(n).alias(h) for n, h in inner.items()], *[k.alias(f"__k{i}") for i, (_, k) in enumerate(keys)])
    on = None
    for i, (a, _) in enumerate(keys):
        test = a == F.col(f"__k{i}")
        on = test if on is None else on & test
    out = left.crossJoin(moved) if kind == "cross" else left.join(moved, on, KINDS[kind])
    if kind in ("semi", "anti"):
        return out.select(*[col(c) for c in left.columns])
    return out.select(*[col(c) for c in left.columns], *[F.col(inner[n]).alias(new) for n, new in renamed.items()])


def ordinal(df: DataFrame) -> DataFrame:
    """``df`` with its input order as a last column: file, block and row where the source tells, else the order of its partitions.

    Files go by their names, as prefixes list them; Spark itself deals files out by size. It has to be put on before any shuffle.
    """
    name, row = hidden(df.columns, "order"), F.monotonically_increasing_id()
    try:
        # Of one file the name says nothing, and texts are dear to compare.
        path = [F.col("_metadata.file_path")] if len(df.inputFiles()) > 1 else []
        return df.withColumn(name, F.struct(*path, F.col("_metadata.file_block_start"), row.alias("row")))
    except AnalysisException:  # what is read from no file has no such columns
        return df.withColumn(name, row)


def distinct_on(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row of each key by the column ``order``, which goes away.

    ``min_by`` combines on the map side, so a hot key sends a row from each task and not all of its rows.
    """
    rest = [c for c in df.columns if c != order]
    one = F.min_by(F.struct(*[col(c) for c in rest]), col(order)).alias("__row")
    named = [k.alias(f"__g{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(one).select(*[F.col("__row").getField(c).alias(c) for c in rest])


def explode(df: DataFrame, column: str, delimiter: str, name: str) -> DataFrame:
    """A row for each part of a delimited text, in its column's place; null rows go, empty parts stay."""
    parts = F.split(col(column), re.escape(delimiter) if delimiter else "", -1)
    made = hidden(df.columns, "part")
    out = df.withColumn(made, F.explode(parts))
    return out.select(*[F.col(made).alias(name) if c == column else col(c) for c in df.columns])


Rel = tuple[DataFrame, dict[str, A.Type]]


def union_by_name(branches: list[Rel], canon: dict[str, A.Type] | None = None) -> Rel:
    """All rows of all branches under the columns of the first (or of ``canon``): missing ones null, further ones dropped.

    Types widen; those that do not go together are refused.
    """
    types = dict(canon if canon is not None else branches[0][1])
    for _, schema in branches:
        for name in types:
            if name in schema:
                types[name] = widen(types[name], schema[name], f"branches' columns {name!r}")
    out: DataFrame | None = None
    for df, schema in branches:
        part = df.select(*[(col(n) if n in schema else F.lit(None)).cast(spark_type(t)).alias(n) for n, t in types.items()])
        out = part if out is None else out.union(part)
    return out, types


def windowed(df: DataFrame, name: str, value: Column, partition: list[Column], order: list[Column], frame: int | str | None, kind: str) -> DataFrame:
    w = Window.partitionBy(*partition)
    if order:
        w = w.orderBy(*order)
    if frame == "all":
        w = w.rowsBetween(Window.unboundedPreceding, 0)
    elif frame is not None:
        w = w.rowsBetween(-frame, 0)
    return df.withColumn(name, value.over(w).cast(kind))


def limited(df: DataFrame, n: int, skip: int = 0) -> DataFrame:
    if n < 0 or skip < 0:
        raise PlanError("LIMIT and OFFSET take whole numbers from 0 on")
    return (df.offset(skip) if skip else df).limit(n)
