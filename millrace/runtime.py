"""Runs scripts: statements in order, on the driver; all data stays in DataFrames."""

from __future__ import annotations

import csv
import dataclasses
import decimal
import os
import re
import sys
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .errors import PlanError, RunError, Thrown, is_transient
from .functions.casts import spark_type
from .lang import ast as A
from .lang.expand import Expander, navigate, to_literal
from .lang.parser import Parser, parse
from .plans.builder import Builder, Rel, relation
from .plans.exprs import compile_expr
from .session import own
from .sinks import files as file_sinks
from .sinks import sql as sql_sinks
from .sinks import stdout
from .sources import body, files, jdbc, rest

CALL_DEPTH = 16
INCLUDE_DEPTH = 16


@dataclass
class Result:
    """What a statement left behind: a frame for a terminal SELECT, and for all the sink and the time."""

    sink: str
    df: DataFrame | None = None
    types: dict[str, A.Type] | None = None
    seconds: float = 0.0
    error: BaseException | None = None
    text: str = ""


@dataclass
class Run:
    """Everything that a run knows from outside: parameters, request, file root, switches."""

    params: dict = field(default_factory=dict)
    request_body: object = None
    headers: dict = field(default_factory=dict)
    jobs: int = 4
    check: bool = False
    quiet: bool = False
    segment: str | None = None
    label: str | None = None
    root: str = "."
    prefix: dict = field(default_factory=dict)
    log: Callable[[str], None] = lambda s: print(s, file=sys.stderr)


def included(source: str, name: str, stack: tuple[str, ...] = ()) -> list[A.Stmt]:
    """A script's statements with those of the files it includes ahead of them."""
    out: list[A.Stmt] = []
    head = True
    for s in parse(source, name):
        if not isinstance(s, A.Include):
            head = False
            out.append(s)
            continue
        if not head:
            raise PlanError("@include goes at the top of a file", s.at)
        path = os.path.normpath(os.path.join(os.path.dirname(name), s.path))
        if path in stack or path == os.path.normpath(name):
            raise PlanError(f"{s.path} includes itself", s.at)
        if len(stack) >= INCLUDE_DEPTH:
            raise PlanError("includes are nested too deeply", s.at)
        try:
            with open(path, encoding="utf-8") as f:
                out += included(f.read(), path, (*stack, os.path.normpath(name)))
        except OSError as e:
            raise PlanError(f"cannot include {s.path}: {e.strerror}", s.at) from e
    return out


class Engine:
    """Scripts of the dialect over a Spark session. ``session`` gets the engine's settings; the one given stays as it is."""

    def __init__(self, spark: SparkSession, run: Run | None = None):
        self.spark, self.run_ = own(spark), run or Run()
        self.values: dict = {}
        self.types: dict[str, A.Type] = {}
        self.functions: dict[str, A.Function] = {}
        self.connections: dict[str, jdbc.Connection] = {}
        self.endpoint: A.Endpoint | None = None
        self.held: list[DataFrame] = []
        self.flush: tuple[float | None, int | None] = (None, None)

    # -- entry points
    def run(self, source: str, name: str = "script") -> list[Result]:
        statements = included(source, name)
        self.declare(statements)
        return self.statements([s for s in statements if not isinstance(s, (A.Connection, A.Function, A.Endpoint, A.ParamDef))])

    def sql(self, source: str) -> DataFrame:
        """The frame of a script's last SELECT, not yet run."""
        found = [r for r in self.run(source) if r.df is not None]
        if not found:
            raise PlanError("the script has no SELECT")
        return found[-1].df

    def check(self, source: str, name: str = "script") -> list[Result]:
        """Plans everything and runs nothing."""
        self.run_ = dataclasses.replace(self.run_, check=True)
        return self.run(source, name)

    # -- declarations
    def declare(self, statements: list[A.Stmt]) -> None:
        names: dict[str, str] = {}
        defined: set[str] = set()
        for s in statements:
            if isinstance(s, (A.ParamDef, A.LetDef)):
                kind = "PARAM" if isinstance(s, A.ParamDef) else "LET"
                if s.name in names:
                    raise PlanError(f"{s.name} is defined twice", s.at)
                names[s.name] = kind
            if isinstance(s, A.LetDef) and s.name in self.run_.params:
                raise PlanError(f"{s.name} is a LET and cannot be bound from outside", s.at)
        for s in statements:
            if isinstance(s, A.Connection):
                if s.name in self.connections and not s.replace:
                    raise PlanError(f"connection {s.name} is there already", s.at)
                self.connections[s.name] = jdbc.Connection(s.name, s.type, {k: os.environ.get(v.path, "") if isinstance(v, A.Param) and v.path not in names else v for k, v in s.options.items()})
            elif isinstance(s, A.Function):
                if s.name in defined and not s.replace:
                    raise PlanError(f"function {s.name} is there already", s.at)
                defined.add(s.name)
                self.functions[s.name] = s
            elif isinstance(s, A.Endpoint):
                self.endpoint = s
            elif isinstance(s, A.ParamDef):
                self.bind(s)
        for k in self.run_.params:
            if k not in names:
                raise PlanError(f"there is no parameter {k}")
        for c in self.connections.values():
            c.options = {k: navigate(v.path, self.values) if isinstance(v, A.Param) else v for k, v in c.options.items()}
            c.options = {k: v.value if isinstance(v, A.Lit) else v for k, v in c.options.items()}
            if c.type in jdbc.DRIVERS and c.options.get("auth") == "ntlm" and c.options.get("tls") == "off":
                raise PlanError(f"connection {c.name}: auth = 'ntlm' needs TLS")

    def bind(self, p: A.ParamDef) -> None:
        run, raw = self.run_, None
        if p.origin == "header":
            raw = {k.lower(): v for k, v in run.headers.items()}.get(p.header.lower())
        elif p.type.kind == "json" or p.origin == "body":
            doc = run.request_body if run.request_body is not None else run.params.get(p.name)
            if isinstance(doc, (str, bytes)):
                import json

                try:
                    doc = json.loads(doc)
                except ValueError as e:
                    raise PlanError(f"{p.name}: no JSON: {e}", p.at) from e
            if doc is None and p.default is None:
                raise PlanError(f"parameter {p.name} is required", p.at)
            self.values[p.name] = doc if doc is not None else p.default
            return
        else:
            raw = run.params.get(p.name)
        if raw is None:
            if p.default is None:
                raise PlanError(f"parameter {p.name} is required", p.at)
            value = p.default.value
            if value is not None and p.default.type != p.type:
                value = scalar(value, p.type, p.name)
        else:
            value = scalar(raw, p.type, p.name)
        self.values[p.name] = A.Lit(value, p.type)

    # -- script expressions
    def expander(self, loop: dict | None = None) -> Expander:
        return Expander({k: f for k, f in self.functions.items()}, self.values | (loop or {}), loop)

    def value(self, e: A.Expr, loop: dict | None = None) -> object:
        """An expression over script values, worked out while planning."""
        e = self.expander(loop).expr(e)
        if isinstance(e, A.Lit):
            return e.value
        c, t = compile_expr(e, {})
        v = self.spark.range(1).select(c.cast(spark_type(t)).alias("v")).first()[0]
        del t
        return v

    def literal(self, e: A.Expr, loop: dict | None = None) -> A.Lit:
        x = self.expander(loop).expr(e)
        if isinstance(x, A.Lit):
            return x
        t = compile_expr(x, {})[1]
        return A.Lit(self.value(e, loop), t)

    def template(self, raw: str, loop: dict | None = None) -> str:
        """Raw SQL with its ``${...}`` filled in."""
        out, i = "", 0
        while (at := raw.find("${", i)) >= 0:
            depth, j, quote = 1, at + 2, False
            while j < len(raw) and depth:
                c = raw[j]
                quote ^= c == "'"
                if not quote:
                    depth += (c == "{") - (c == "}")
                j += 1
            if depth:
                raise PlanError("unterminated ${...}")
            hole = raw[at + 2 : j - 1].strip()
            p = Parser(hole)
            e = p.expr()
            if p.tok.kind != "end":
                raise p.fail("unexpected text in ${...}")
            scope = {n: v for n, v in self.values.items()} | (loop or {})
            v = Expander(self.functions, scope, scope).expr(e)
            out += raw[i:at] + self.shown(v if isinstance(v, A.Lit) else self.literal(e, loop))
            i = j
        return out + raw[i:]

    @staticmethod
    def shown(x: A.Lit) -> str:
        v = x.value
        if v is None:
            return ""
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return format(decimal.Decimal(repr(v)), "f").removesuffix(".0")
        return str(v)

    def named(self, x: object, loop: dict | None = None) -> str | None:
        """A name that is text, with holes maybe, or an IDENTIFIER expression."""
        if x is None:
            return None
        if isinstance(x, A.Expr):
            x = self.value(x, loop)
            if not isinstance(x, str) or not x:
                raise PlanError("IDENTIFIER() needs a text that is not empty")
            return x
        return self.template(x, loop) if "${" in x else x

    # -- statements
    def statements(self, statements: list[A.Stmt], loop: dict | None = None, depth: int = 0, bindings: dict | None = None) -> list[Result]:
        out: list[Result] = []
        for s in statements:
            try:
                out += self.statement(s, loop, depth)
            except PlanError as e:
                if e.at is None:
                    raise type(e)(e.message, s.at) from e
                raise
        return out

    def statement(self, s: A.Stmt, loop: dict | None, depth: int) -> list[Result]:
        if isinstance(s, A.Output):
            return [self.output(s, loop)]
        if isinstance(s, A.LetDef):
            self.values[s.name] = self.literal(s.value, loop)
            return []
        if isinstance(s, A.Throw):
            if s.when is None or self.value(s.when, loop) is True:
                raise Thrown(self.shown(self.literal(s.message, loop)), s.at)
            return []
        if isinstance(s, A.Print):
            if not self.run_.quiet:
                self.run_.log(self.rendered(s.value, loop))
            return []
        if isinstance(s, A.CallStmt):
            return self.call(s, loop, depth)
        if isinstance(s, A.CaseStmt):
            return self.statements(self.chosen(s, loop), loop, depth)
        if isinstance(s, A.ForEach):
            return self.for_each(s, loop, depth)
        raise PlanError(f"{type(s).__name__} cannot stand here", s.at)

    def rendered(self, e: A.Expr, loop: dict | None) -> str:
        x = self.expander(loop).expr(e)
        if isinstance(x, A.Lit) and not isinstance(x.value, float):
            return self.shown(x)
        from .functions.casts import text

        c, t = compile_expr(x, {})
        return self.spark.range(1).select(text(c, t).alias("v")).first()[0] or ""

    def chosen(self, s: A.CaseStmt, loop: dict | None) -> list[A.Stmt]:
        subject = self.shown(self.literal(s.subject, loop)) if s.subject is not None else None
        for tests, body_ in s.whens:
            for t in tests:
                hit = self.shown(self.literal(t, loop)) == subject if subject is not None else self.value(t, loop) is True
                if hit:
                    return body_
        return s.other

    def call(self, s: A.CallStmt, loop: dict | None, depth: int) -> list[Result]:
        if depth >= CALL_DEPTH:
            raise PlanError("CALLs are nested too deeply", s.at)
        f = self.functions.get(s.name.lower())
        if f is None or not isinstance(f.body, list):
            raise PlanError(f"there is no statement function {s.name}", s.at)
        least = sum(d is None for _, _, d in f.params)
        if not least <= len(s.args) <= len(f.params):
            raise PlanError(f"{f.name} takes {least if least == len(f.params) else f'{least} to {len(f.params)}'} arguments", s.at)
        given = dict(loop or {})
        for i, (name, t, default) in enumerate(f.params):
            x = self.literal(s.args[i], loop) if i < len(s.args) else default
            if t is not None and x.value is not None and x.type.kind != t.kind:
                x = A.Lit(scalar(x.value, t, name), t)
            given[name] = x
        return self.statements(f.body, given, depth + 1)

    def for_each(self, s: A.ForEach, loop: dict | None, depth: int) -> list[Result]:
        rows = self.discovered(s.source, [n for n, _ in s.names], loop)
        loops = []
        for r in rows:
            given = dict(loop or {})
            for (name, t), v in zip(s.names, r, strict=True):
                given[name] = A.Lit(scalar(v, t, name), t) if t is not None and v is not None else to_literal(v)
            loops.append(given)

        def one(given: dict) -> list[Result]:
            try:
                return self.statements(s.body, given, depth)
            except Thrown:
                raise
            except Exception as e:  # noqa: BLE001  ON ERROR CONTINUE keeps going after whatever failed
                if not s.go_on:
                    raise
                return [Result("for each", error=e)]

        if not s.parallel or len(loops) < 2 or self.run_.check:
            return [r for given in loops for r in one(given)]
        # Spark runs jobs of several threads side by side; each row's failure is its own.
        with ThreadPoolExecutor(min(self.run_.jobs, len(loops))) as pool:
            return [r for part in pool.map(one, loops) for r in part]

    def discovered(self, source: object, names: list[str], loop: dict | None, types: bool = False) -> list[tuple]:
        """Rows of a discovery source: a query's first columns by place, a document's fields by name."""
        del types
        if isinstance(source, A.Param):
            doc = navigate(source.path, self.values | (loop or {}))
            doc = doc.value if isinstance(doc, A.Lit) else doc
            if not isinstance(doc, list):
                raise PlanError(f"${source.path} is no array")
            return [tuple(x.get(n, "") if isinstance(x, dict) else x for n in names) for x in doc]
        if isinstance(source, str) and source.lower().endswith(".csv"):
            with open(self.path(source), newline="", encoding="utf-8") as f:
                return [tuple((r.get(n) or "") for n in names) for r in csv.DictReader(f)]
        if isinstance(source, A.Query):
            df, found = self.builder(loop).query(self.expander(loop).any(source))
        else:
            df, found = self.open(self.expander(loop).any(source), None, loop)
        if len(found) < len(names):
            raise PlanError(f"the discovery has {len(found)} columns for {len(names)} names")
        # One row a table or pipeline: what a script loops over is a catalogue.
        return [tuple(r[: len(names)]) for r in df.collect()]

    # -- queries and sinks
    def builder(self, loop: dict | None = None) -> Builder:
        return Builder(self.spark, lambda s, b: self.open(s, b, loop))

    def query(self, q: A.Query, loop: dict | None = None) -> Rel:
        return self.builder(loop).query(self.expander(loop).any(q))

    def path(self, p: str) -> str:
        """A local path under the run's root; addresses stay as they are."""
        for k, v in self.run_.prefix.items():
            if p.startswith(k):
                return v + p[len(k) :]
        if re.match(r"[a-z0-9]+://|[a-z]+:/|/", p):
            return p
        return os.path.join(self.run_.root, p) if self.run_.root != "." else p

    def connection(self, name: str) -> jdbc.Connection:
        if name not in self.connections:
            raise PlanError(f"unknown connection {name!r}")
        return self.connections[name]

    def open(self, s: A.Source, builder: Builder | None, loop: dict | None = None) -> Rel:
        df, types = self.opened(s, loop)
        if s.options.get("buffer") and not self.run_.check:
            # The whole source is read before a sink opens, as both may be one place.
            df = df.persist(StorageLevel.DISK_ONLY)
            self.held.append(df)
            df.count()
        return df, types

    def opened(self, s: A.Source, loop: dict | None = None) -> Rel:
        if s.kind == "file":
            given = self.named(s.name, loop)
            if isinstance(s.name, A.Expr):
                files.format_of(given, s.options)
            return relation(files.read(self.spark, self.path(given), s.options))
        if s.kind == "body":
            if self.run_.request_body is None:
                if self.run_.check:
                    return relation(self.spark.createDataFrame([], body.schema(s.columns)))
                raise PlanError("FROM BODY needs a request")
            return relation(body.read(self.spark, self.run_.request_body, s.columns))
        if s.kind == "buffer":
            from .streaming import drain

            columns = self.endpoint.accept if self.endpoint and self.endpoint.accept else None
            self.flush = s.flush
            root = os.path.join(self.path(str(s.options.get("at") or (self.endpoint.options.get("at") if self.endpoint else None) or ".")), str(s.name))
            return relation(drain.replay(self.spark, root, columns, self.run_.segment))
        if s.kind in ("url", "rest"):
            conn_options = {}
            if s.kind == "rest":
                c = self.connection(s.conn)
                if c.type != "http":
                    raise PlanError(f"connection {s.conn} is no http connection")
                base = str(c.options.get("base_url") or c.options.get("url") or "").rstrip("/")
                url = base + self.template(s.name, loop)
                conn_options = {k: v for k, v in c.options.items() if k not in ("base_url", "url")} | {k: v for k, v in (("user", c.credential("USER")), ("password", c.credential("PASS"))) if v}
            else:
                url = str(self.value(s.name, loop))
            return relation(rest.read(self.spark, rest.request_of(url, s, conn_options)))
        if s.kind in ("table", "raw"):
            c = self.connection(s.conn)
            push = str(self.template(str(self.value(s.pushdown, loop) or ""), loop)) if s.pushdown is not None else None
            name = self.named(s.name, loop) if s.kind == "table" else None
            raw = self.template(str(self.value(s.name, loop)), loop) if s.kind == "raw" else None
            query = jdbc.query_of(c, self.named(s.schema, loop), name, raw, push)
            if "split" in s.options:
                return relation(jdbc.load_sliced(self.spark, c, query, str(s.options["split"]), int(s.options.get("slices", self.run_.jobs))))
            if s.kind == "table":
                return relation(jdbc.load_table(self.spark, c, self.named(s.schema, loop), name, query, self.run_.jobs))
            return relation(jdbc.load(self.spark, c, query))
        if s.kind == "each":
            return self.each_table(s, loop)
        raise PlanError(f"cannot read from {s.kind}")

    def each_table(self, s: A.Source, loop: dict | None) -> Rel:
        from .functions.library import widen
        from .operators.relational import union_by_name
        from pyspark.sql import functions as F

        names = s.each or ("table", "tag")
        fields = [str(s.options.get("table_field", "table")), str(s.options.get("tag_field", "tag"))] if isinstance(s.query, A.Param) else list(names)
        conn = s.conn or self._conn_of(s.query)
        rows = self.discovered(s.query, fields, loop)
        if not rows:
            raise PlanError("the discovery found no table")
        del widen
        rels = []
        for table, tag in rows:
            if "tag_substr" in s.options:
                start, size = map(int, str(s.options["tag_substr"]).split(","))
                tag = str(table)[start - 1 : start - 1 + size]
            source = A.Source("table", str(table), conn, None, pushdown=s.pushdown) if conn else A.Source("file", str(table), options=dict(s.options))
            if conn and "." in str(table):
                source.schema, source.name = str(table).rsplit(".", 1)
            df, types = self.open(source, None, loop)
            rels.append((df.select(F.lit(str(tag)).alias(names[1]), *[F.col("`" + c + "`") for c in types if c != names[1]]), {names[1]: A.STRING} | {c: t for c, t in types.items() if c != names[1]}))
        canon = {names[1]: A.STRING} | self.open(self.expander(loop).any(s.anchor), None, loop)[1] if s.anchor is not None else None
        return union_by_name(rels, canon)

    @staticmethod
    def _conn_of(q: object) -> str | None:
        if isinstance(q, A.Source):
            return q.conn
        if isinstance(q, A.Query):
            return q.branches[0].source.conn
        return None

    def output(self, s: A.Output, loop: dict | None) -> Result:
        began = time.time()
        sink = dataclasses.replace(s.sink, keys=[self.literal(k, loop).value for k in s.sink.keys], options={k: self.value(v, loop) if isinstance(v, A.Expr) else v for k, v in s.sink.options.items()})
        sink.name = self.named(sink.name, loop)
        sink.schema = self.named(sink.schema, loop)
        where = "stdout" if sink.kind == "stdout" else str(sink.name)
        sink.keys = [self.template(k, loop) if isinstance(k, str) and "${" in k else k for k in sink.keys]
        if sink.mode == "upsert" and any(not k for k in sink.keys):
            raise PlanError("an UPSERT key is empty")
        if sink.kind == "file":
            sink.name = self.path(sink.name)
            file_sinks.checked(sink.name, sink.mode, sink.options)
            if sink.split or sink.jobs:
                sink.options.setdefault("jobs", sink.jobs)
        held = len(self.held)
        df, types = self.query(s.query, loop)
        for k in [*sink.keys, *sink.partial, *sink.split]:
            if k not in types:
                raise PlanError(f"unknown column {k!r} in the sink's clauses")
        if sink.kind == "table":
            conn = self.connection(sink.conn)
            if sink.mode == "upsert" and not sink.keys:
                sink.keys = self.inferred_key(s.query, loop)
        if sink.kind == "file" and sink.jobs:
            df = df.repartitionByRange(sink.jobs, *[df["`" + c + "`"] for c in sink.split]) if sink.split else df.repartition(sink.jobs)
        if s.explain:
            return Result(where, text=self.explained(df, types, where, s.explain))
        if sink.kind == "stdout":
            return Result(where, df, types)
        if not self.run_.check:
            if sink.kind == "file":
                file_sinks.write(df, types, sink.name, sink.mode, sink.options)
            else:
                options = sink.options | ({"using": sink.using} if sink.using else {})
                sql_sinks.write(df, types, conn, sink.schema, sink.name, sink.mode, sink.keys, sink.partial, sink.split, sink.jobs, options, self.run_.label)
            # What was buffered is written; a SELECT's frame, which is not yet run, keeps its own.
            while loop is None and len(self.held) > held:
                self.held.pop().unpersist()
        return Result(where, seconds=time.time() - began)

    def inferred_key(self, q: A.Query, loop: dict | None) -> list[str]:
        s = self.expander(loop).any(q.branches[0].source)
        if len(q.branches) != 1 or s.kind != "table":
            raise PlanError("a bare UPSERT needs a table read to take the key from; write UPSERT ON (...)")
        keys = jdbc.primary_key(self.spark, self.connection(s.conn), self.named(s.schema, loop), self.named(s.name, loop))
        if not keys:
            raise PlanError(f"{s.name} has no primary key; write UPSERT ON (...)")
        return keys

    def explained(self, df: DataFrame, types: dict[str, A.Type], where: str, mode: str) -> str:
        jdf = df._jdf.queryExecution()
        lines = [f"output: {where}", "schema: " + ", ".join(f"{n} {t}" for n, t in types.items())]
        if mode == "analyze" and not self.run_.check:
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            lines.append(f"ran in {time.time() - began:.3f} s, nothing written")
        return "\n".join([*lines, jdf.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).rstrip()])


def scalar(v: object, t: A.Type, name: str) -> object:
    """A value from outside as a parameter's type."""
    try:
        return body.value(v.strip() if isinstance(v, str) and t.kind != "string" else v, t, name)
    except RunError as e:
        raise PlanError(str(e)) from e


def show(r: Result, form: str = "table") -> list[str]:
    if r.text:
        return [r.text]
    if r.df is None:
        return []
    return list(stdout.ndjson(r.df, r.types)) if form == "json" else [stdout.table(r.df, r.types)]


def exit_code(e: BaseException | None) -> int:
    """0 done, 1 for good, 75 worth another try, 130 interrupted."""
    if e is None:
        return 0
    if isinstance(e, KeyboardInterrupt):
        return 130
    return 75 if is_transient(e) else 1


__all__ = ["Engine", "Result", "Run", "exit_code", "show"]
