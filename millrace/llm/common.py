"""What the operators share: shared-folder tables, row keys, word and span expressions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) is one made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of a small table that go into one file.
ROWS_A_FILE = 1_000_000


def table(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and outlives executors.

    ``parts`` bounds the number of files, for what is known to be small.
    """
    path = f"{shared_dir(df.sparkSession)}/millrace/{name}-{uuid.uuid4().hex}"
    out = df if parts is None else df.coalesce(parts)
    out.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame) -> int:
    """How many files hold at most as many narrow rows as a table that is read already has."""
    return files_for(df.count())


def files_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_FILE))


class Held:
    """Frames that are read more than once, as tables until ``free()``.

    Tables outlive executors, and plans over them are short: the driver keeps the plan of every query that has run, so kept frames
    that carry theirs along would fill it.
    """

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str = "held", parts: int | None = None) -> DataFrame:
        self.frames.append(table(df, name, parts))
        return self.frames[-1]

    def free(self) -> None:
        while self.frames:
            drop_table(self.frames.pop())


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a ``table()`` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        if "/millrace/" in f:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that readers and Arrow hold at a time. Texts run to megabytes, so the defaults of 4096 and 10000 rows have no useful bound.
FRUGAL = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}


def frugal(spark: SparkSession) -> None:
    """Sets ``FRUGAL`` on the session, where it was not set smaller."""
    for k, v in FRUGAL.items():
        if int(spark.conf.get(k, "1000000")) > int(v):
            spark.conf.set(k, v)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frugal(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any letter case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the values alone, so that reruns agree."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 50)) + F.lit(0.5)) / F.lit(float(1 << 50))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` and the lambdas in it read it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def blocks(items: Column) -> Column:
    """``items``, a bound array, cut into about as many arrays as each is long."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"), F.lit(1))
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, size))


def running(items: Column, step: Callable[[Column, Column], Column], kind: str = "long") -> Column:
    """What a fold with ``step`` from 0 has after each item, as an array.

    A fold that appends copies what it has each time, so that is done for a block of items at a time: the work grows with
    the power 1.5 of their number.
    """
    last = lambda a, otherwise: F.coalesce(F.try_element_at(a, F.lit(-1)), otherwise)
    inner = lambda block, first: F.aggregate(block, F.array().cast(f"array<{kind}>"), lambda out, x: F.concat(out, F.array(step(last(out, first), x))))
    whole = lambda items: F.aggregate(blocks(items), F.array().cast(f"array<array<{kind}>>"), lambda done, block: F.concat(done, F.array(inner(block, last(F.try_element_at(done, F.lit(-1)), F.lit(0).cast(kind))))))
    return F.flatten(bound(items, whole))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of ``struct(start, end, match)`` of the leftmost non-overlapping matches, in code points, end exclusive.

    ``split`` and ``regexp_extract_all`` scan alike, so pieces and matches alternate.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), found, lambda p, m: F.struct((F.length(p) + F.length(m)).cast("long").alias("step"), m.alias("match")))
    spans = lambda pairs: F.zip_with(pairs, running(pairs, lambda at, x: at + x["step"]), lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["match"].alias("match")))
    return bound(pairs, spans)
