"""From a query of the syntax tree to a DataFrame. Building is planning: nothing runs, and all refusals happen here."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions import library as L
from ..functions.casts import spark_type
from ..lang import ast as A
from ..lang.expand import children, walk
from ..lang.parser import AGGREGATES
from ..operators import relational as R
from .exprs import boolean, column, compile_expr

Rel = tuple[DataFrame, dict[str, A.Type]]


def dialect_type(t: T.DataType, metadata: dict | None = None) -> A.Type | None:
    """The dialect's type of a Spark one; None for what it has no name for."""
    if (metadata or {}).get("logical") == "time":
        return A.TIME
    if isinstance(t, T.DecimalType):
        return A.Type("decimal", t.precision, t.scale)
    return {
        "boolean": A.BOOL, "byte": A.INT, "short": A.INT, "integer": A.INT, "long": A.INT, "float": A.FLOAT, "double": A.FLOAT, "string": A.STRING, "varchar": A.STRING, "char": A.STRING,
        "binary": A.BYTES, "date": A.DATE, "timestamp": A.TIMESTAMP, "timestamp_ntz": A.TIMESTAMP, "void": A.UNKNOWN,
    }.get(t.typeName())


def relation(df: DataFrame) -> Rel:
    """A source's frame in the dialect's types: numbers widened, structs flattened to dotted names, lists and maps left out."""
    out, types = [], {}

    def add(c, name: str, t: T.DataType, metadata: dict) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                add(c.getField(f.name), f"{name}.{f.name}", f.dataType, f.metadata)
            return
        kind = dialect_type(t, metadata)
        if kind is not None and name not in types:
            types[name] = kind
            out.append((c if t.simpleString() == spark_type(kind) else c.cast(spark_type(kind))).alias(name))

    for f in df.schema.fields:
        add(column(f.name), f.name, f.dataType, f.metadata)
    return df.select(*out), types


class Builder:
    """Builds queries. ``open_source`` reads what is no CTE, subquery, RANGE or single row."""

    def __init__(self, spark: SparkSession, open_source: Callable[[A.Source, Builder], Rel]):
        self.spark, self.open_source = spark, open_source
        self.bindings: dict[str, A.Query] = {}

    # -- sources
    def source(self, s: A.Source, scope: dict[str, A.Query]) -> Rel:
        if s.kind == "ref":
            if s.name not in scope:
                raise PlanError(f"unknown table {s.name!r}")
            # A CTE sees the ones before it.
            names = list(scope)
            return self.query(scope[s.name], {n: scope[n] for n in names[: names.index(s.name)]})
        if s.kind == "derived":
            return self.query(s.query, scope)
        if s.kind == "unit":
            return self.spark.range(1).select(), {}
        if s.kind == "range":
            bounds = []
            for e in s.name:
                if not isinstance(e, A.Lit) or e.type.kind != "int":
                    raise PlanError("RANGE takes whole numbers or parameters")
                bounds.append(e.value)
            low, high = bounds if len(bounds) == 2 else (0, bounds[0])
            return self.spark.range(low, max(low, high)).select(F.col("id").alias("range")), {"range": A.INT}
        return self.open_source(s, self)

    # -- queries
    def query(self, q: A.Query, scope: dict[str, A.Query] | None = None) -> Rel:
        scope = dict(scope if scope is not None else self.bindings)
        for name, sub in q.ctes:
            scope.pop(name, None)
            scope[name] = sub
        single = len(q.branches) == 1
        if single:
            df, types, post = self.select(q.branches[0], scope, [e for e, _ in q.order])
        else:
            rels = [self.select(b, scope, [])[:2] for b in q.branches]
            canon = self.source(q.anchor, scope)[1] if q.anchor else None
            if canon is not None:
                # Tag columns are no part of the authority's table, but of every branch.
                tags = {i.name: rels[0][1][i.name] for i in q.branches[0].items if i.alias and i.name not in canon}
                canon = tags | canon
            df, types = R.union_by_name(rels, canon)
            post = {}
        if q.order:
            keys, extra = [], []
            for i, (e, descending) in enumerate(q.order):
                name = post.get(i) or self._output_column(e, types, q.branches[0].items if single else [])
                if name is None:
                    raise PlanError("ORDER BY must name a column of the result" if not isinstance(e, A.Col) else f"unknown field {e.name!r} in ORDER BY")
                if name not in types:
                    extra.append(name)
                keys.append(R.ordering(column(name), descending))
            df = df.orderBy(*keys)
        if q.limit is not None:
            df = R.limited(df, *[self._whole(x) for x in (q.limit, q.offset) if x is not None])
        if list(df.columns) != list(types):
            df = df.select(*[column(n) for n in types])
        return df, types

    @staticmethod
    def _whole(e: A.Expr) -> int:
        if not isinstance(e, A.Lit) or e.type.kind != "int":
            raise PlanError("LIMIT and OFFSET take whole numbers")
        return e.value

    @staticmethod
    def _output_column(e: A.Expr, types: dict, items: list[A.Item]) -> str | None:
        if isinstance(e, A.Lit) and isinstance(e.value, int) and 1 <= e.value <= len(types):
            return list(types)[e.value - 1]
        if isinstance(e, A.Col) and e.name in types:
            return e.name
        for i in items:
            if isinstance(i.expr, A.Expr) and i.expr == e:
                return i.name
        return None

    def select(self, s: A.Select, scope: dict[str, A.Query], order: list[A.Expr]) -> tuple[DataFrame, dict[str, A.Type], dict[int, str]]:
        """The frame, its columns, and for ORDER BY items that are no output column the hidden ones that have them."""
        df, types = self.source(self._by_footers(s), scope)
        if s.distinct_on:
            df = R.ordinal(df)  # before anything shuffles
        ordinal = df.columns[-1] if s.distinct_on else None
        left_alias = {s.source.alias or (s.source.name if s.source.kind == "ref" else None)}
        for j in s.joins:
            if isinstance(j, A.Unnest):
                if not isinstance(j.column, A.Col) or j.column.name not in types:
                    raise PlanError(f"UNNEST takes a column: unknown field {getattr(j.column, 'name', '?')!r}")
                if types[j.column.name].kind != "string":
                    raise PlanError("UNNEST splits text")
                new = j.alias or j.column.name
                if new != j.column.name and new in types:
                    raise PlanError(f"column {new!r} is there already")
                df = R.explode(df, j.column.name, j.delimiter, new)
                types = {new if n == j.column.name else n: t for n, t in types.items()}
                continue
            df, types = self._join(df, types, j, scope, left_alias, ordinal)
            left_alias.add(j.source.alias or j.source.name)
        if s.where is not None:
            df = df.where(boolean(self._no_aggregates(s.where, "WHERE"), types, "WHERE"))
        items = self._expanded(s.items, types)
        aggregated = bool(s.group) or any(self._has_aggregate(i.expr) for i in items) or s.having is not None
        replaced: dict[A.Expr, A.Expr] = {}
        if aggregated:
            df, types, items, replaced = self._aggregate(df, types, s, items, order)
            if s.having is not None:
                df = df.where(boolean(self._replace(s.having, replaced), types, "HAVING"))
        return self._project(df, types, s, items, order, replaced, ordinal)

    @staticmethod
    def _by_footers(s: A.Select) -> A.Source:
        """The source, marked where all that is asked of it may stand in the footers of Parquet files."""
        plain = lambda e: isinstance(e, A.Call) and e.name in ("count", "min", "max") and not getattr(e, "distinct", False) and all(isinstance(a, (A.Col, A.Star)) for a in e.args)
        if s.source.kind != "file" or s.joins or s.where is not None or s.group or s.distinct_on or not s.items or not all(plain(i.expr) for i in s.items):
            return s.source
        return dataclasses.replace(s.source, options={**s.source.options, "footers": True})

    @staticmethod
    def _has_aggregate(e: object) -> bool:
        return _finds_aggregate(e)

    @staticmethod
    def _no_aggregates(e: A.Expr, where: str) -> A.Expr:
        if _finds_aggregate(e):
            raise PlanError(f"an aggregate cannot stand in {where}")
        return e

    def _join(self, df: DataFrame, types: dict, j: A.Join, scope: dict, left_alias: set, ordinal: str | None) -> Rel:
        right, right_types = self.source(j.source, scope)
        alias = j.source.alias or j.source.name
        keys = []
        for a, b in j.on:
            side = lambda c: "right" if c.table == alias and alias not in left_alias else "left" if c.table in left_alias and c.table is not None else None
            sa, sb = side(a), side(b)
            swapped = sa == "right" or sb == "left"
            if sa is None and sb is None:
                straight, crossed = a.name in types and b.name in right_types, b.name in types and a.name in right_types
                if straight and crossed and a.name != b.name:
                    raise PlanError(f"join key {a.name} = {b.name} is ambiguous; qualify it")
                swapped = crossed and not straight
            l, r = (b, a) if swapped else (a, b)
            if l.name not in types:
                raise PlanError(f"unknown join key {l.name!r} on the left")
            if r.name not in right_types:
                raise PlanError(f"unknown join key {r.name!r} on the right")
            t = L.widen(types[l.name], right_types[r.name], f"join keys {l.name} and {r.name}")
            keys.append((L.coerced(column(l.name), types[l.name], t), L.coerced(column(r.name), right_types[r.name], t)))
        names = R.joined_names(list(types), list(right_types))
        out = R.join(df, right, j.kind, keys, names)
        if j.kind in ("semi", "anti"):
            return out, types
        if ordinal:  # it belongs to the left side and stays last
            out = out.select(*[column(n) for n in [*types, *names.values(), ordinal]])
        return out, types | {names[n]: t for n, t in right_types.items()}

    @staticmethod
    def _expanded(items: list[A.Item], types: dict[str, A.Type]) -> list[A.Item]:
        out = []
        for i in items:
            if not isinstance(i.expr, A.Star):
                out.append(i)
                continue
            renamed = dict(i.expr.rename)
            for old in renamed:
                if old not in types:
                    raise PlanError(f"RENAME: unknown field {old!r}")
            out += [A.Item(A.Col(n, None, True), renamed.get(n, n), n in renamed) for n in types if n not in i.expr.exclude]
        seen = set()
        for i in out:
            if i.name in seen:
                raise PlanError(f"column {i.name!r} is there twice; give it another alias")
            seen.add(i.name)
        return out

    # -- aggregation
    def _aggregate(self, df, types, s: A.Select, items: list[A.Item], order: list[A.Expr]):
        keys: list[tuple[A.Expr, str]] = []
        for g in s.group:
            e, name = g, None
            if isinstance(g, A.Lit) and g.type.kind == "int":
                if not 1 <= g.value <= len(items):
                    raise PlanError(f"GROUP BY {g.value}: there is no such column")
                e, name = items[g.value - 1].expr, items[g.value - 1].name
            elif isinstance(g, A.Col) and g.name not in types:
                hit = next((i for i in items if i.name == g.name), None)
                if hit is None:
                    raise PlanError(f"unknown field {g.name!r} in GROUP BY")
                e, name = hit.expr, hit.name
            del name
            if _finds_aggregate(e):
                raise PlanError("GROUP BY cannot name an aggregate")
            keys.append((e, R.hidden(types, f"key{len(keys)}")))
        calls: list[A.Call] = []
        places = [*(i.expr for i in items), *([s.having] if s.having is not None else []), *order]
        for p in places:
            for e in walk(p) if isinstance(p, A.Expr) else []:
                if isinstance(e, A.Call) and e.name in AGGREGATES and e not in calls:
                    calls.append(e)
        if not calls:
            if s.having is not None and not s.group:
                raise PlanError("HAVING needs an aggregate")
            raise PlanError("GROUP BY without an aggregate; write SELECT DISTINCT")
        if s.having is not None and not s.group and not any(_finds_aggregate(i.expr) for i in items):
            raise PlanError("HAVING without GROUP BY needs an aggregate in the SELECT list")
        made, out_types, replaced = [], {}, {}
        compiled = [compile_expr(e, types) for e, _ in keys]
        for (e, name), (_, t) in zip(keys, compiled, strict=True):
            out_types[name] = t
            replaced[e] = A.Col(name, None, True)
        for n, call in enumerate(calls):
            name = R.hidden(types, f"agg{n}")
            c, t = aggregate(call, types)
            made.append(c.alias(name))
            out_types[name] = t
            replaced[call] = A.Col(name, None, True)
        named = [c.alias(n) for (c, _), (_, n) in zip(compiled, keys, strict=True)]
        df = df.groupBy(*named).agg(*made)
        new_items = []
        for i in items:
            e = self._replace(i.expr, replaced)
            for x in walk(e):
                if isinstance(x, A.Col) and x.name not in out_types:
                    raise PlanError(f"column {x.name!r} must be grouped by or inside an aggregate")
            new_items.append(A.Item(e, i.name, i.alias))
        return df, out_types, new_items, replaced

    def _replace(self, e: A.Expr, replaced: dict[A.Expr, A.Expr]) -> A.Expr:
        if e in replaced:
            return replaced[e]
        return children(e, lambda x: self._replace(x, replaced))

    # -- projection
    def _project(self, df, types, s, items, order, replaced, ordinal):
        windows = [i for i in items if isinstance(i.expr, A.Window)]
        if len({(w.expr.partition, w.expr.order) for w in windows}) > 1:
            raise PlanError("one SELECT takes one window; put the other into a subquery")
        out, out_types, names = [], {}, {}
        work = dict(types)
        for i in windows:
            w = i.expr
            name = R.hidden(work, f"win{len(work)}")
            c, t = window_value(w, types)
            part = [compile_expr(e, types)[0] for e in w.partition]
            by = [R.ordering(compile_expr(e, types)[0], d) for e, d in w.order]
            df = R.windowed(df, name, c, part, by, w.frame, spark_type(t))
            work[name] = t
            names[id(i)] = name
        for i in items:
            c, t = (column(names[id(i)]), work[names[id(i)]]) if id(i) in names else compile_expr(i.expr, types)
            out.append(c.alias(i.name))
            out_types[i.name] = t
        post: dict[int, str] = {}
        for n, e in enumerate(order):
            raw = self._replace(e, replaced) if replaced else e
            if isinstance(e, A.Lit) or isinstance(e, A.Col) and e.name in out_types or any(isinstance(i.expr, A.Expr) and i.expr in (e, raw) for i in items):
                name = self._output_column(e, out_types, items) or self._output_column(raw, out_types, items)
                if name:
                    post[n] = name
                continue
            names_in = {x.name for x in walk(raw) if isinstance(x, A.Col)}
            if s.distinct or s.distinct_on:
                raise PlanError("ORDER BY of a DISTINCT query must name its columns")
            name = R.hidden([*types, *out_types], f"sort{n}")
            if names_in <= set(types):
                c, _ = compile_expr(raw, types)
                out.append(c.alias(name))
            elif names_in <= set(out_types) | set(types):
                # An expression over aliases: each stands for its item.
                by_name = {i.name: i.expr for i in items}
                swap = lambda x: by_name[x.name] if isinstance(x, A.Col) and x.name in by_name and x.name not in types else children(x, swap)
                c, _ = compile_expr(swap(raw), types)
                out.append(c.alias(name))
            else:
                missing = next(iter(sorted(names_in - set(types) - set(out_types))))
                raise PlanError(f"unknown field {missing!r} in ORDER BY")
            post[n] = name
        if ordinal and not replaced:
            out.append(column(ordinal))
        df = df.select(*out)
        if s.distinct:
            df = df.distinct()
        if s.distinct_on:
            keys = []
            for e in s.distinct_on:
                name = self._output_column(e, out_types, items)
                if name is None:
                    raise PlanError("DISTINCT ON names columns of the SELECT list")
                keys.append(column(name))
            df = R.distinct_on(df if not replaced else df.withColumn(ordinal, F.monotonically_increasing_id()), keys, ordinal)
        return df, out_types, post


def _finds_aggregate(e: object) -> bool:
    """Whether an aggregate call stands in ``e`` outside of windows."""
    if isinstance(e, A.Window):
        return any(_finds_aggregate(a) for a in e.call.args)
    if isinstance(e, A.Call) and e.name in AGGREGATES:
        return True
    found: list = []
    if isinstance(e, A.Expr):
        children(e, lambda x: (found.append(x), x)[1])
    return any(map(_finds_aggregate, found))


def aggregate(call: A.Call, types: dict[str, A.Type]) -> L.Typed:
    if call.star:
        return F.count(F.lit(1)), A.INT
    if len(call.args) != 1:
        raise PlanError(f"{call.name.upper()} takes one argument")
    if _finds_aggregate(call.args[0]):
        raise PlanError("aggregates do not nest")
    c, t = compile_expr(call.args[0], types)
    if call.name == "count":
        return (F.count_distinct(c) if call.distinct else F.count(c)), A.INT
    if call.name in ("min", "max"):
        return (F.min if call.name == "min" else F.max)(c), t
    if call.name == "avg":
        if t.kind not in (*L.NUMERIC, "unknown"):
            raise PlanError(f"AVG does not take {t}")
        return F.avg(c.cast("double")), A.FLOAT
    if t.kind == "string":
        return F.sum(c.cast("bigint")), A.INT
    if t.kind not in (*L.NUMERIC, "unknown"):
        raise PlanError(f"SUM does not take {t}")
    if t.kind == "decimal":
        return F.sum(c).cast(f"decimal(38,{t.s})"), A.Type("decimal", 38, t.s)
    return (F.sum(c), t) if t.kind != "unknown" else (F.sum(c.cast("bigint")), A.INT)


def window_value(w: A.Window, types: dict[str, A.Type]) -> L.Typed:
    name, args = w.call.name, w.call.args
    if name in ("row_number", "rank", "dense_rank"):
        if args:
            raise PlanError(f"{name.upper()} takes no argument")
        return {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[name](), A.INT
    if name in ("lag", "lead"):
        if not args or len(args) > 2 or not isinstance(args[0], A.Col):
            raise PlanError(f"{name.upper()} takes a column and a number of rows")
        n = 1
        if len(args) == 2:
            if not isinstance(args[1], A.Lit) or args[1].type.kind != "int" or args[1].value < 0:
                raise PlanError(f"{name.upper()}: the number of rows is a whole number from 0 on")
            n = args[1].value
        c, t = compile_expr(args[0], types)
        return (F.lag if name == "lag" else F.lead)(c, n), t
    if w.call.distinct:
        raise PlanError("a window's COUNT takes no DISTINCT")
    _, t = aggregate(w.call, types)
    if name == "sum" and t.kind == "decimal":
        t = A.FLOAT
    if w.call.star:
        return F.count(F.lit(1)), t
    # A cast goes around the whole window, and so not around the aggregate inside it.
    x, have = compile_expr(args[0], types)
    if name in ("sum", "avg"):
        x = x.cast("double") if t.kind == "float" else x.cast("bigint") if have.kind in ("string", "unknown") else x
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](x), t



