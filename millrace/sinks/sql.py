"""SQL tables: appended to, replaced, upserted into, and StarRocks by Stream Load."""

from __future__ import annotations

import base64
import json
import urllib.request
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError, RunError
from ..functions.casts import text
from ..lang import ast as A
from ..sources.jdbc import Connection, quote, table_name

#: Bytes of a Stream Load.
FLUSH = 8 << 20


def column_type(t: A.Type, dialect: str) -> str:
    kinds = {
        "postgres": {"bool": "BOOLEAN", "int": "BIGINT", "float": "DOUBLE PRECISION", "string": "TEXT", "bytes": "BYTEA", "date": "DATE", "timestamp": "TIMESTAMP", "time": "TIME"},
        "mysql": {"bool": "BOOLEAN", "int": "BIGINT", "float": "DOUBLE", "string": "LONGTEXT", "bytes": "LONGBLOB", "date": "DATE", "timestamp": "DATETIME(6)", "time": "TIME(6)"},
        "sqlserver": {"bool": "BIT", "int": "BIGINT", "float": "FLOAT", "string": "NVARCHAR(MAX)", "bytes": "VARBINARY(MAX)", "date": "DATE", "timestamp": "DATETIME2(6)", "time": "TIME(6)"},
    }[dialect]
    return f"DECIMAL({t.p},{t.s})" if t.kind == "decimal" else kinds.get(t.kind, kinds["string"])


def create_statement(conn: Connection, schema: str | None, name: str, types: dict[str, A.Type], keys: list[str]) -> str:
    d = conn.dialect
    columns = []
    for n, t in types.items():
        kind = column_type(t, d)
        if n in keys and t.kind == "string":  # text without bound cannot be a key
            kind = {"mysql": "VARCHAR(255)", "sqlserver": "NVARCHAR(450)"}.get(d, kind)
        columns.append(f"{quote(n, d)} {kind}{' NOT NULL' if n in keys else ''}")
    if conn.type == "starrocks":
        o = conn.options
        head = ", ".join(columns).replace("LONGTEXT", "STRING").replace("DATETIME(6)", "DATETIME")
        keyed = f" PRIMARY KEY ({', '.join(quote(k, d) for k in keys)})" if keys else ""
        spread = f" DISTRIBUTED BY HASH ({quote((keys or list(types))[0], d)}) BUCKETS {o.get('buckets', 8)}"
        return f"CREATE TABLE IF NOT EXISTS {table_name(conn, schema, name)} ({head}){keyed}{spread} PROPERTIES (\"replication_num\" = \"{o.get('replication_num', 1)}\")"
    if keys:
        columns.append(f"PRIMARY KEY ({', '.join(quote(k, d) for k in keys)})")
    made = f"{table_name(conn, schema, name)} ({', '.join(columns)})"
    if d == "sqlserver":
        return f"IF OBJECT_ID(N'{(schema + '.' if schema else '') + name}') IS NULL CREATE TABLE {made}"
    return f"CREATE TABLE IF NOT EXISTS {made}"


def upsert_statement(conn: Connection, schema: str | None, name: str, stage: str, columns: list[str], keys: list[str], partial: list[str] | None = None) -> str:
    """From a staging table into the target, once for all rows."""
    d = conn.dialect
    q = lambda c: quote(c, d)
    target, source = table_name(conn, schema, name), table_name(conn, schema, stage)
    changed = [c for c in (partial or columns) if c not in keys]
    listed = ", ".join(map(q, columns))
    if d == "postgres":
        then = "DO UPDATE SET " + ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in changed) if changed else "DO NOTHING"
        return f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {source} ON CONFLICT ({', '.join(map(q, keys))}) {then}"
    if d == "mysql":
        then = ", ".join(f"{q(c)} = VALUES({q(c)})" for c in changed) or f"{q(keys[0])} = {q(keys[0])}"
        return f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {source} ON DUPLICATE KEY UPDATE {then}"
    on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{q(c)} = s.{q(c)}' for c in changed)}" if changed else ""
    return f"MERGE INTO {target} AS t USING {source} AS s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join(f's.{q(c)}' for c in columns)});"


def execute(df: DataFrame, conn: Connection, *statements: str) -> None:
    """Statements on the driver's own connection, through the JVM's driver manager."""
    jvm = df.sparkSession.sparkContext._jvm
    p = conn.properties()
    props = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in p:
            props.setProperty(k, p[k])
    jvm.java.lang.Class.forName(p["driver"])
    c = jvm.java.sql.DriverManager.getConnection(p["url"], props)
    try:
        for s in statements:
            st = c.createStatement()
            st.execute(s)
            st.close()
    finally:
        c.close()


def write(df: DataFrame, types: dict[str, A.Type], conn: Connection, schema: str | None, name: str, mode: str | None, keys: list[str], partial: list[str], split: list[str], jobs: int | None, options: dict, label: str | None = None) -> None:
    for k in [*keys, *partial, *split]:
        if k not in types:
            raise PlanError(f"unknown column {k!r} in the sink's clauses")
    if split or jobs:
        n = jobs or df.sparkSession.sparkContext.defaultParallelism
        df = df.repartitionByRange(n, *[F.col("`" + c + "`") for c in split]) if split else df.repartition(n)
    if options.get("using") == "stream_load" or conn.type == "starrocks" and options.get("using") != "jdbc":
        stream_load(df, types, conn, schema, name, mode, keys, partial, options, label)
        return
    p = conn.properties()
    url = p.pop("url")
    target = table_name(conn, schema, name)
    kinds = ", ".join(f"`{n}` {column_type(t, conn.dialect)}" for n, t in types.items())
    if mode != "upsert":
        if options.get("auto_create", True):
            execute(df, conn, create_statement(conn, schema, name, types, []))
        df.write.mode("overwrite" if mode == "replace" else "append").option("truncate", "true").option("createTableColumnTypes", kinds).jdbc(url, target, properties=p)
        return
    stage = f"{name}_stage_{uuid.uuid4().hex[:12]}"
    execute(df, conn, create_statement(conn, schema, name, types, keys), create_statement(conn, schema, stage, types, []))
    try:
        df.write.mode("append").jdbc(url, table_name(conn, schema, stage), properties=p)
        execute(df, conn, upsert_statement(conn, schema, name, stage, list(types), keys, partial))
    finally:
        execute(df, conn, f"DROP TABLE {table_name(conn, schema, stage)}")


def tsv_line(types: dict[str, A.Type]):
    """A row for Stream Load. A text that reads ``\\N`` would come out as null and is refused."""
    cells = []
    for n, t in types.items():
        c = F.col("`" + n.replace("`", "``") + "`")
        s = F.base64(c) if t.kind == "bytes" else text(c, t)
        if t.kind == "string":
            s = F.when(s == "\\N", F.raise_error(F.lit(f"{n}: the text \\N cannot be loaded"))).otherwise(F.translate(s, "\t\n\r", "   "))
        cells.append(F.coalesce(s, F.lit("\\N")))
    return F.concat_ws("\t", *cells)


def stream_load(df: DataFrame, types: dict[str, A.Type], conn: Connection, schema: str | None, name: str, mode: str | None, keys: list[str], partial: list[str], options: dict, label: str | None = None) -> None:
    """Every task loads its rows in pieces; a piece's label is the same when a task is tried again, so it lands once."""
    o = conn.options | options
    if o.get("auto_create", True) and "fe_host" in o and o.get("ddl", True):
        statements = [create_statement(conn, schema, name, types, keys)]
        if mode == "replace":
            statements.append(f"TRUNCATE TABLE {table_name(conn, schema, name)}")
        execute(df, conn, *statements)
    base = str(o.get("be_url") or f"http://{o.get('fe_host')}:{o.get('http_port', 8030)}").rstrip("/")
    url = f"{base}/api/{schema or o.get('database')}/{name}/_stream_load"
    token = base64.b64encode(f"{conn.credential('USER') or 'root'}:{conn.credential('PASS') or ''}".encode()).decode()
    run = label or f"{o.get('label_prefix', 'millrace')}_{name}_{uuid.uuid4().hex}"
    headers = {"Authorization": f"Basic {token}", "Expect": "100-continue", "column_separator": "\\t", "columns": ",".join(f"`{n}`" for n in types)}
    if partial:
        headers |= {"partial_update": "true", "columns": ",".join(f"`{n}`" for n in types if n in keys + partial)}

    def send(batches):
        import urllib.request

        from pyspark import TaskContext

        import pyarrow as pa

        part, piece, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> None:
            nonlocal piece, size
            request = urllib.request.Request(url, ("\n".join(held) + "\n").encode(), headers | {"label": f"{run}_{part}_{piece}"}, method="PUT")
            with urllib.request.urlopen(request, timeout=600) as r:
                answer = json.load(r)
            if answer.get("Status") not in ("Success", "Publish Timeout", "Label Already Exists"):
                raise RunError(f"stream load: {answer.get('Message') or answer}", transient="timeout" in str(answer).lower())
            held.clear()
            piece, size = piece + 1, 0

        n = 0
        for b in batches:
            for line in b.column(0).to_pylist():
                held.append(line)
                size, n = size + len(line) + 1, n + 1
                if size >= FLUSH:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["rows"])

    df.select(tsv_line(types).alias("line")).mapInArrow(send, "rows long").agg(F.sum("rows")).collect()
