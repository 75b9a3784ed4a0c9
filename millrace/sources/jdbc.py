"""Tables and queries of SQL servers by JDBC, and the SQL that each dialect wants."""

from __future__ import annotations

import datetime
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import PlanError

DRIVERS = {"postgres": ("org.postgresql.Driver", 5432), "mysql": ("com.mysql.cj.jdbc.Driver", 3306), "starrocks": ("com.mysql.cj.jdbc.Driver", 9030), "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433)}
#: From this many estimated rows on a table is read in slices without being asked to.
SPLIT_ROWS = 2_000_000


@dataclass
class Connection:
    """A named endpoint. User and password come from ``NAME_USER`` and ``NAME_PASS`` unless its options have them."""

    name: str
    type: str
    options: dict

    def credential(self, what: str) -> str | None:
        key = {"USER": "user", "PASS": "password"}[what]
        return self.options.get(key) or os.environ.get(f"{self.name.upper()}_{what}")

    @property
    def dialect(self) -> str:
        return "mysql" if self.type == "starrocks" else self.type

    def url(self) -> str:
        o = self.options
        if o.get("auth") == "ntlm" and o.get("tls") == "off":
            raise PlanError(f"connection {self.name}: auth = 'ntlm' needs TLS")
        if "url" in o:
            return o["url"]
        host = o.get("fe_host") or o.get("host")
        if not host:
            raise PlanError(f"connection {self.name} has no host")
        port, db, tls = o.get("fe_port") or o.get("port"), o.get("database", ""), o.get("tls")
        if self.type == "sqlserver":
            at = host.replace("\\", "\\\\") if "\\" in host else host
            out = f"jdbc:sqlserver://{at}" + (f":{port}" if port or "\\" not in host else "") if port else f"jdbc:sqlserver://{at}"
            out += f";databaseName={db}" if db else ""
            out += ";encrypt=false" if tls == "off" else ";encrypt=true" + (";trustServerCertificate=true" if tls == "insecure" else "")
            if o.get("auth") == "ntlm":
                user = self.credential("USER") or ""
                domain = o.get("domain") or (user.split("\\")[0] if "\\" in user else "")
                out += f";integratedSecurity=true;authenticationScheme=NTLM;domain={domain}"
            return out
        port = port or DRIVERS[self.type][1]
        if self.type == "postgres":
            return f"jdbc:postgresql://{host}:{port}/{db}" + {"require": "?sslmode=verify-full", "insecure": "?sslmode=require", "off": "?sslmode=disable"}.get(tls, "")
        return f"jdbc:mysql://{host}:{port}/{db}" + {"require": "?sslMode=VERIFY_IDENTITY", "insecure": "?sslMode=REQUIRED", "off": "?sslMode=DISABLED"}.get(tls, "")

    def properties(self) -> dict[str, str]:
        user = self.credential("USER")
        if user and "\\" in user:
            user = user.split("\\", 1)[1]
        out = {"url": self.url(), "driver": self.options.get("driver", DRIVERS.get(self.type, ("",))[0]), "fetchsize": str(self.options.get("fetchsize", 10_000))}
        return {k: v for k, v in (out | {"user": user, "password": self.credential("PASS")}).items() if v}


def quote(name: str, dialect: str) -> str:
    if dialect == "mysql":
        return "`" + name.replace("`", "``") + "`"
    if dialect == "sqlserver":
        return "[" + name.replace("]", "]]") + "]"
    return '"' + name.replace('"', '""') + '"'


def table_name(conn: Connection, schema: str | None, name: str) -> str:
    return ".".join(quote(p, conn.dialect) for p in (schema, name) if p)


def query_of(conn: Connection, schema: str | None, name: str | None, raw: str | None, pushdown: str | None) -> str:
    """The SELECT that is sent: a table or raw query, with a verbatim predicate if there is one."""
    base = f"SELECT * FROM {table_name(conn, schema, name)}" if name else f"SELECT * FROM ({raw}) q"
    return f"{base} WHERE {pushdown}" if pushdown and pushdown.strip() else base if name else raw


def key_query(conn: Connection, schema: str | None, name: str) -> str:
    """Finds a table's primary key, in key order."""
    t = name.replace("'", "''")
    s = (schema or "").replace("'", "''")
    if conn.dialect == "mysql":
        where = f"TABLE_SCHEMA = '{s}'" if s else "TABLE_SCHEMA = DATABASE()"
        return f"SELECT COLUMN_NAME FROM information_schema.KEY_COLUMN_USAGE WHERE {where} AND TABLE_NAME = '{t}' AND CONSTRAINT_NAME = 'PRIMARY' ORDER BY ORDINAL_POSITION"
    where = f" AND tc.TABLE_SCHEMA = '{s}'" if s else ""
    return (
        "SELECT kcu.COLUMN_NAME FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS tc JOIN INFORMATION_SCHEMA.KEY_COLUMN_USAGE kcu ON kcu.CONSTRAINT_NAME = tc.CONSTRAINT_NAME "
        f"AND kcu.TABLE_SCHEMA = tc.TABLE_SCHEMA AND kcu.TABLE_NAME = tc.TABLE_NAME WHERE tc.CONSTRAINT_TYPE = 'PRIMARY KEY' AND tc.TABLE_NAME = '{t}'{where} ORDER BY kcu.ORDINAL_POSITION"
    )


def rows_query(conn: Connection, schema: str | None, name: str) -> str:
    """A server's own estimate of a table's rows."""
    t, s = name.replace("'", "''"), (schema or "").replace("'", "''")
    if conn.dialect == "mysql":
        return f"SELECT TABLE_ROWS FROM information_schema.TABLES WHERE TABLE_NAME = '{t}' AND TABLE_SCHEMA = " + (f"'{s}'" if s else "DATABASE()")
    if conn.dialect == "postgres":
        return f"SELECT CAST(reltuples AS BIGINT) AS n FROM pg_class WHERE oid = '{table_name(conn, schema, name).replace(chr(39), chr(39) * 2)}'::regclass"
    return f"SELECT SUM(row_count) AS n FROM sys.dm_db_partition_stats WHERE object_id = OBJECT_ID(N'{s + '.' if s else ''}{t}') AND index_id < 2"


def slices(column: str, low: int, high: int, n: int, dialect: str) -> list[str]:
    """Predicates that cut a table by an integer key: nulls go to the first slice, the last one is open."""
    c, n = quote(column, dialect), max(1, min(n, high - low + 1))
    step = -(-(high - low + 1) // n)
    cuts = [low + i * step for i in range(1, n) if low + i * step <= high]
    if not cuts:
        return ["1 = 1"]
    out = [f"{c} < {cuts[0]} OR {c} IS NULL"]
    out += [f"{c} >= {a} AND {c} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [*out, f"{c} >= {cuts[-1]}"]


def uuid_slices(column: str, n: int, dialect: str) -> list[str]:
    """The same for UUID keys, by their first byte."""
    c = quote(column, dialect)
    cuts = [f"'{i * 256 // n:02x}000000-0000-0000-0000-000000000000'" for i in range(1, n)]
    if not cuts:
        return ["1 = 1"]
    out = [f"{c} < {cuts[0]} OR {c} IS NULL"]
    out += [f"{c} >= {a} AND {c} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [*out, f"{c} >= {cuts[-1]}"]


def date_slices(column: str, low: datetime.date, high: datetime.date, n: int, dialect: str) -> list[str]:
    """The same for date and time keys, by days."""
    c, days = quote(column, dialect), (high - low).days + 1
    n = max(1, min(n, days))
    step = -(-days // n)
    cuts = [f"'{(low + datetime.timedelta(days=i * step)).isoformat()[:10]}'" for i in range(1, n) if i * step < days]
    if not cuts:
        return ["1 = 1"]
    out = [f"{c} < {cuts[0]} OR {c} IS NULL"]
    out += [f"{c} >= {a} AND {c} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [*out, f"{c} >= {cuts[-1]}"]


def load(spark: SparkSession, conn: Connection, query: str) -> DataFrame:
    if conn.type not in DRIVERS:
        raise PlanError(f"connection {conn.name}: {conn.type!r} is no SQL connector")
    return spark.read.format("jdbc").options(**conn.properties()).option("query", query).load()


def load_sliced(spark: SparkSession, conn: Connection, query: str, column: str, n: int) -> DataFrame:
    """A query in ``n`` slices of a key, each a partition of its own."""
    q = quote(column, conn.dialect)
    low, high = load(spark, conn, f"SELECT MIN({q}) AS a, MAX({q}) AS b FROM ({query}) s").first()
    if low is None:
        return load(spark, conn, query)
    if isinstance(low, int):
        predicates = slices(column, low, high, n, conn.dialect)
    elif isinstance(low, datetime.date):  # datetime is one, too
        predicates = date_slices(column, low, high, n, conn.dialect)
    elif isinstance(low, str) and conn.dialect == "postgres":
        predicates = uuid_slices(column, n, conn.dialect)
    else:
        return load(spark, conn, query)
    p = conn.properties()
    return spark.read.jdbc(p.pop("url"), f"({query}) s", predicates=predicates, properties=p)


def load_table(spark: SparkSession, conn: Connection, schema: str | None, name: str, query: str, jobs: int) -> DataFrame:
    """A table, in slices of its key if the server says that it is large and the key is one column."""
    if jobs > 1 and conn.options.get("auto_split", True):
        row = load(spark, conn, rows_query(conn, schema, name)).first()
        if row and row[0] is not None and int(row[0]) >= SPLIT_ROWS:
            keys = primary_key(spark, conn, schema, name)
            if len(keys) == 1:
                return load_sliced(spark, conn, query, keys[0], jobs)
    return load(spark, conn, query)


def primary_key(spark: SparkSession, conn: Connection, schema: str | None, name: str) -> list[str]:
    return [r[0] for r in load(spark, conn, key_query(conn, schema, name)).collect()]
