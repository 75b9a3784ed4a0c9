"""Exact-path CSV and Parquet files, written in parallel and put in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.casts import text
from ..lang import ast as A
from ..sources.files import dialect, format_of, located, stores


def checked(path: str, mode: str | None, options: dict) -> str:
    """The format; explicit APPEND is for CSV files on file systems only."""
    kind = format_of(path, options)
    if mode == "upsert":
        raise PlanError("UPSERT needs a table")
    if mode == "append" and (kind == "parquet" or path.startswith(("az://", "s3://"))):
        raise PlanError(f"APPEND cannot extend {path}; use REPLACE or a path of its own")
    if kind == "csv":
        dialect(options, writing=True)
    return kind


def _fs(df: DataFrame, path: str):
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(located(path))
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), jvm, p


def write(df: DataFrame, types: dict[str, A.Type], path: str, mode: str | None, options: dict) -> None:
    """Parts are written by all tasks beside the target and then joined byte by byte, so that no task holds the whole.

    A Parquet file comes from one last task, as footers cannot be joined.
    ``WITH (parts)`` keeps a directory of parts instead.
    """
    kind = checked(path, mode, options)
    stores(df.sparkSession, path)
    fs, jvm, target = _fs(df, path)
    if options.get("parts"):
        (df.write.mode("overwrite").parquet(located(path)) if kind == "parquet" else _csv(df, types, options, True).write.mode("overwrite").text(located(path)))
        return
    stage = jvm.org.apache.hadoop.fs.Path(target.getParent() or jvm.org.apache.hadoop.fs.Path("."), f".{target.getName()}.{uuid.uuid4().hex}")
    try:
        if kind == "parquet":
            single(df).write.parquet(str(stage))
        else:
            _csv(df, types, options, False).write.text(str(stage))
        parts = sorted((str(f.getPath()) for f in fs.listStatus(stage) if f.getPath().getName().startswith("part-")))
        if kind == "parquet":
            if fs.exists(target):
                fs.delete(target, True)
            fs.rename(jvm.org.apache.hadoop.fs.Path(parts[0]), target)
            return
        top = bytearray((header(list(types), dialect(options)[0]) + "\n").encode())
        if mode != "append" and _joined(fs, jvm, target, stage, top, parts):
            return
        append = mode == "append" and fs.exists(target) and fs.getFileStatus(target).getLen() > 0
        if fs.exists(target) and fs.getFileStatus(target).isDirectory():
            fs.delete(target, True)
        out = fs.append(target) if append and _appends(fs) else fs.create(target, True) if not append else None
        if out is None:  # a file system without append: the old bytes come first in a new file
            old = jvm.org.apache.hadoop.fs.Path(f"{stage}.old")
            fs.rename(target, old)
            out = fs.create(target, True)
            _copy(fs, jvm, old, out)
            fs.delete(old, False)
        try:
            if not append:
                out.write(top)
            for p in parts:
                _copy(fs, jvm, jvm.org.apache.hadoop.fs.Path(p), out)
        finally:
            out.close()
    finally:
        fs.delete(stage, True)


def single(df: DataFrame) -> DataFrame:
    """``df`` in one task at the end, with all work before that in as many as it has.

    Sorted rows are dealt out by their sort already and stay in order; others, which have none, take a shuffle.
    """
    top = df._jdf.queryExecution().optimizedPlan().nodeName()
    return df.coalesce(1) if top in ("Sort", "GlobalLimit", "Range", "LocalRelation") else df.repartition(1)


def _joined(fs, jvm, target, stage, top: bytearray, parts: list[str]) -> bool:
    """Has the store itself join the parts behind the header, where it can (HDFS), so that no byte comes to the driver."""
    if fs.getScheme() != "hdfs":
        return False
    first = jvm.org.apache.hadoop.fs.Path(stage, "header")
    out = fs.create(first, True)
    out.write(top)
    out.close()
    if parts:
        paths = [jvm.org.apache.hadoop.fs.Path(p) for p in parts if fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(p)).getLen()]
        array = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Path"), len(paths))
        for i, p in enumerate(paths):
            array[i] = p
        if paths:
            fs.concat(first, array)
    fs.delete(target, True)
    return bool(fs.rename(first, target))


def _appends(fs) -> bool:
    return fs.getScheme() == "hdfs"


def _copy(fs, jvm, path, out) -> None:
    source = fs.open(path)
    try:
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
    finally:
        source.close()


def header(names: list[str], delimiter: str) -> str:
    return delimiter.join('"' + n.replace('"', '""') + '"' if any(c in n for c in (delimiter, '"', "\n", "\r")) else n for n in names)


def csv_line(types: dict[str, A.Type], delimiter: str):
    """A row as a line: null is nothing, an empty text is ``""``, quotes where they are needed."""
    cells = []
    for name, t in types.items():
        c = F.col("`" + name.replace("`", "``") + "`")
        s = text(c if t.kind != "unknown" else c.cast("string"), t if t.kind != "unknown" else A.STRING)
        if t.kind == "bytes":
            s = F.base64(c)
        if t.kind in ("string", "bytes", "unknown"):
            special = s.contains(delimiter) | s.contains('"') | s.contains("\n") | s.contains("\r")
            s = F.when(s == "", '""').when(special, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
        elif delimiter in ".-:":
            s = F.concat(F.lit('"'), s, F.lit('"'))
        cells.append(F.coalesce(s, F.lit("")))
    return F.concat_ws(delimiter, *cells)


def _csv(df: DataFrame, types: dict[str, A.Type], options: dict, with_header: bool) -> DataFrame:
    delimiter = dialect(options, writing=True)[0]
    lines = df.select(csv_line(types, delimiter).alias("value"))
    if with_header:
        top = df.sparkSession.createDataFrame([(header(list(types), delimiter),)], "value string")
        lines = top.union(lines)
    return lines
