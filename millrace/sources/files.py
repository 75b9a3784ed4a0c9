"""CSV and Parquet files: local, by HTTP, in object stores, compressed or in a zip, alone or by prefix."""

from __future__ import annotations

import io
import os
import posixpath
import re
import tempfile
import urllib.request
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import PlanError, RunError
from ..functions.casts import spark_type
from ..lang import ast as A
from . import csvtypes

ENCODINGS = {"utf8": "UTF-8", "utf-8": "UTF-8", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "cp1252": "windows-1252", "windows-1252": "windows-1252"}
CODECS = (".gz", ".zst")
#: Bytes of a file that are looked at for its types.
HEAD = 4 << 20


def located(path: str) -> str:
    """The address that Spark's readers take: ``az://account/container/x`` and ``s3://bucket/x`` are spelled its way."""
    if m := re.fullmatch(r"az://([^/]+)/([^/]+)/(.*)", path):
        return f"abfss://{m[2]}@{m[1]}.dfs.core.windows.net/{m[3]}"
    if path.startswith("s3://"):
        return "s3a://" + path[5:]
    return path


def stores(spark: SparkSession, path: str) -> None:
    """Hands the credentials and endpoints that the environment has to Hadoop's file systems."""
    conf, env = spark.sparkContext._jsc.hadoopConfiguration(), os.environ
    if path.startswith("s3://"):
        for key, name in (("access.key", "AWS_ACCESS_KEY_ID"), ("secret.key", "AWS_SECRET_ACCESS_KEY"), ("session.token", "AWS_SESSION_TOKEN"), ("endpoint.region", "AWS_REGION"), ("endpoint", "AWS_ENDPOINT_URL")):
            if name in env:
                conf.set(f"fs.s3a.{key}", env[name])
        if "AWS_ENDPOINT_URL" in env:
            conf.set("fs.s3a.path.style.access", "true")
    elif path.startswith("az://") and "AZURE_STORAGE_KEY" in env:
        conf.set(f"fs.azure.account.key.{path[5:].split('/')[0]}.dfs.core.windows.net", env["AZURE_STORAGE_KEY"])


def format_of(path: str, options: dict) -> str:
    """csv or parquet, by ``WITH (format = ...)`` or the extension under a codec's."""
    wanted = options.get("format")
    if wanted is not None:
        if str(wanted).lower() not in ("csv", "parquet"):
            raise PlanError(f"format {wanted!r} is not supported; csv or parquet")
        return str(wanted).lower()
    name = path.split("?")[0] if "://" in path else path
    for c in CODECS:
        name = name.removesuffix(c)
    ext = posixpath.splitext(name)[1].lower()
    if ext not in (".csv", ".parquet"):
        raise PlanError(f"{path!r}: the extension names no format; add WITH (format = 'csv' or 'parquet')")
    return ext[1:]


def build_limit(options: dict) -> int | None:
    """The bytes of ``WITH (max_build = '16GB')``. Nothing is held back by it, as Spark's joins spill; it has to be a size all the same."""
    given = options.get("max_build")
    if given is None:
        return None
    m = re.fullmatch(r"\s*([0-9]+)\s*(?:([kmgt])i?)?b?\s*", str(given), re.I)
    if not m:
        raise PlanError(f"max_build {given!r} is no size")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[(m[2] or "").lower()]


def dialect(options: dict, writing: bool = False) -> tuple[str, str]:
    """Delimiter and encoding."""
    d = options.get("delimiter", ",")
    d = "\t" if d == "tab" else d
    if not isinstance(d, str) or len(d.encode()) != 1:
        raise PlanError("the delimiter is one byte, or tab")
    e = str(options.get("encoding", "utf8")).lower()
    if e not in ENCODINGS:
        raise PlanError(f"encoding {e!r} is not supported")
    if writing and "encoding" in options:
        raise PlanError("a CSV sink always writes UTF-8")
    return d, ENCODINGS[e]


def scratch(spark: SparkSession) -> str:
    """A folder for what has to be fetched or unpacked first: shared by all executors on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared and shared.startswith(("file:", "/")):
        base = shared.removeprefix("file://").removeprefix("file:")
        os.makedirs(base, exist_ok=True)
        return tempfile.mkdtemp(prefix="fetched-", dir=base)
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RunError("reading by HTTP or from a zip on a cluster needs spark.checkpoint.dir on a shared file system")
    return tempfile.mkdtemp(prefix="millrace-")


def fetched(spark: SparkSession, url: str) -> str:
    """A copy of a file behind http(s), as Spark has no such file system."""
    name = posixpath.basename(url.split("?")[0]) or "data"
    path = os.path.join(scratch(spark), name)
    try:
        with urllib.request.urlopen(url, timeout=60) as r, open(path, "wb") as f:
            while chunk := r.read(1 << 20):
                f.write(chunk)
    except OSError as e:
        raise RunError(f"{url}: {e}", transient=getattr(e, "code", 503) in (429, 500, 502, 503, 504)) from e
    return path


def unzipped(spark: SparkSession, path: str, member: str | None) -> str:
    """One member of a local archive, unpacked in pieces. Several and no name are refused."""
    if "://" in path:
        raise PlanError("an archive is read from a local path only")
    try:
        with zipfile.ZipFile(path) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            if member is None:
                if len(names) != 1:
                    raise PlanError(f"{path} holds {len(names)} files; name one with '::': {', '.join(names[:8])}")
                member = names[0]
            if member not in names:
                raise PlanError(f"{path} has no {member!r}; it holds {', '.join(names[:8])}")
            out = os.path.join(scratch(spark), posixpath.basename(member))
            with z.open(member) as r, open(out, "wb") as f:
                while chunk := r.read(1 << 20):
                    f.write(chunk)
            return out
    except (OSError, zipfile.BadZipFile) as e:
        raise PlanError(f"{path}: {e}") from e


def head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file, decompressed, through Spark's own file systems, so that any store works."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(located(path))
    conf = sc._jsc.hadoopConfiguration()
    fs = p.getFileSystem(conf)
    try:
        stream = fs.open(p)
    except Exception as e:  # noqa: BLE001  whatever the store calls a missing file
        raise PlanError(f"{path}: {str(e).splitlines()[0]}") from e
    try:
        raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()
    if path.endswith(".gz"):
        import zlib

        return zlib.decompressobj(31).decompress(raw, size)
    if path.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read(size)
    return raw


def listed(spark: SparkSession, prefix: str) -> list[str]:
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(located(prefix))
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    found = sorted(str(f.getPath()) for f in fs.listStatus(p) if f.isFile() and not str(f.getPath().getName()).startswith(("_", ".")))
    if not found:
        raise PlanError(f"{prefix} is empty")
    return found


def read_csv(spark: SparkSession, paths: list[str], options: dict) -> DataFrame:
    """CSV under types from its first records. A later cell that does not parse is an error of the run."""
    delimiter, encoding = dialect(options)
    first: dict[str, A.Type] | None = None
    quoted_breaks = False
    for i, path in enumerate(paths):
        text = head(spark, path).decode(encoding, "replace")
        rows = csvtypes.records(text, delimiter, csvtypes.SAMPLE + 1 if i == 0 else 1)
        names = list(csvtypes.schema(rows[:1]))
        if first is None:
            first = csvtypes.schema(rows)
            quoted_breaks = any("\n" in c for r in rows for c, _ in r)
        elif names != list(first):
            raise PlanError(f"{path}: its header differs from {paths[0]}'s")
    if not first:
        return spark.createDataFrame([], T.StructType())
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(spark_type(t)), True) for n, t in first.items()])
    reader = spark.read.schema(schema).options(
        header=True, sep=delimiter, encoding=encoding, quote='"', escape='"', mode="FAILFAST", enforceSchema=True,
        emptyValue="", nullValue="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        # A quoted line end means that a file cannot be split by lines; without one, large files are.
        multiLine=quoted_breaks or bool(options.get("multiline")), maxCharsPerColumn=-1, maxColumns=max(20480, len(first) + 1),
    )
    return reader.csv([located(p) for p in paths])


def read_parquet(spark: SparkSession, paths: list[str], options: dict) -> DataFrame:
    """Parquet files; by the reader that answers from their footers where ``options`` say that this may be enough."""
    if not options.get("footers"):
        return spark.read.parquet(*map(located, paths))
    # Which reader it is gets settled when the frame is made. The session is the engine's own.
    v1 = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in v1.split(",") if x != "parquet"))
    try:
        return spark.read.parquet(*map(located, paths))
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", v1)


def read(spark: SparkSession, path: str, options: dict) -> DataFrame:
    stores(spark, path)
    build_limit(options)
    archive, _, member = (x.strip() for x in path.partition("::"))
    if member or archive.lower().endswith(".zip"):
        if options.get("format") == "parquet" or member.lower().endswith(".parquet"):
            raise PlanError("Parquet cannot be read through a zip or codec")
        inner = unzipped(spark, archive, member or None)
        format_of(inner, options)
        return read_csv(spark, [inner], options)
    if path.endswith("/"):
        paths = listed(spark, path)
        kinds = {format_of(p, options) for p in paths}
        if len(kinds) > 1:
            raise PlanError(f"{path} holds files of several formats")
        return read_csv(spark, paths, options) if kinds == {"csv"} else read_parquet(spark, paths, options)
    kind = format_of(path, options)
    if kind == "parquet" and path.endswith(CODECS):
        raise PlanError("Parquet cannot be read through a zip or codec")
    if path.startswith(("http://", "https://")):
        path = fetched(spark, path)
    if kind == "csv":
        return read_csv(spark, [path], options)
    try:
        return read_parquet(spark, [path], options)
    except Exception as e:  # noqa: BLE001  a missing path is found while planning
        raise PlanError(f"{path}: {str(e).splitlines()[0]}") from e
