"""Expressions, queries and statements, as values that compare by structure."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Type:
    kind: str  # bool int float decimal string bytes date time timestamp json unknown
    p: int = 38
    s: int = 0

    def __str__(self) -> str:
        return f"DECIMAL({self.p},{self.s})" if self.kind == "decimal" else self.kind.upper()


BOOL, INT, FLOAT, STRING, BYTES, DATE, TIME, TIMESTAMP, UNKNOWN, JSON = map(Type, "bool int float string bytes date time timestamp unknown json".split())


class Expr:
    """Base of all expressions."""


@dataclass(frozen=True)
class Lit(Expr):
    value: object
    type: Type = UNKNOWN


@dataclass(frozen=True)
class Col(Expr):
    name: str
    table: str | None = field(default=None, compare=False)
    quoted: bool = field(default=False, compare=False)


@dataclass(frozen=True)
class Param(Expr):
    path: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Un(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class In(Expr):
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Is(Expr):
    arg: Expr
    what: str  # null | empty
    negated: bool = False


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[tuple[Expr, ...], Expr], ...]
    other: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    type: Type
    safe: bool = False


@dataclass(frozen=True)
class Let(Expr):
    name: str
    value: Expr
    body: Expr


@dataclass(frozen=True)
class Window(Expr):
    call: Call
    partition: tuple[Expr, ...]
    order: tuple[tuple[Expr, bool], ...]
    frame: int | str | None = None  # None default, "all" unbounded rows, or n preceding rows


@dataclass(frozen=True)
class Star:
    table: str | None = None
    exclude: tuple[str, ...] = ()
    rename: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Item:
    expr: Expr | Star
    name: str
    alias: bool = False


@dataclass
class Source:
    """``kind``: file table raw rest url body buffer range unit ref derived each."""

    kind: str
    name: object = None
    conn: str | None = None
    schema: object = None
    query: object = None
    columns: list = field(default_factory=list)
    options: dict = field(default_factory=dict)
    pushdown: Expr | None = None
    paginate: tuple[str, dict] | None = None
    retry: tuple[int, tuple[int, ...]] | None = None
    each: tuple[str, ...] = ()
    anchor: object = None
    flush: tuple[float | None, int | None] = (None, None)
    alias: str | None = None


@dataclass
class Join:
    kind: str
    source: Source
    on: list[tuple[Col, Col]]
    options: dict


@dataclass
class Unnest:
    column: Expr
    delimiter: str
    alias: str | None


@dataclass
class Select:
    items: list[Item]
    source: Source
    joins: list = field(default_factory=list)
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    distinct: bool = False
    distinct_on: list[Expr] = field(default_factory=list)


@dataclass
class Query:
    ctes: list[tuple[str, Query]]
    branches: list[Select]
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: Expr | None = None
    offset: Expr | None = None
    anchor: Source | None = None


@dataclass
class Sink:
    """``kind``: file table stdout."""

    kind: str
    name: object = None
    conn: str | None = None
    schema: object = None
    using: str | None = None
    mode: str | None = None  # append replace upsert
    keys: list[Expr] = field(default_factory=list)
    partial: list[str] = field(default_factory=list)
    split: list[str] = field(default_factory=list)
    jobs: int | None = None
    options: dict = field(default_factory=dict)


@dataclass
class Stmt:
    at: tuple[str, int, int]


@dataclass
class Output(Stmt):
    sink: Sink
    query: Query
    explain: str | None = None  # None, "plan" or "analyze"


@dataclass
class ParamDef(Stmt):
    name: str
    type: Type
    default: Lit | None
    origin: str | None = None
    header: str | None = None


@dataclass
class LetDef(Stmt):
    name: str
    value: Expr


@dataclass
class Throw(Stmt):
    message: Expr
    when: Expr | None


@dataclass
class Print(Stmt):
    value: Expr


@dataclass
class Connection(Stmt):
    name: str
    type: str
    options: dict
    replace: bool


@dataclass
class Function(Stmt):
    name: str
    params: list[tuple[str, Type | None, Expr | None]]
    body: object  # an Expr, or a list of statements
    replace: bool


@dataclass
class CallStmt(Stmt):
    name: str
    args: list[Expr]


@dataclass
class ForEach(Stmt):
    source: object  # a Query, Source, Param or path of a CSV file
    names: list[tuple[str, Type | None]]
    parallel: bool
    go_on: bool
    body: list[Stmt]


@dataclass
class CaseStmt(Stmt):
    subject: Expr | None
    whens: list[tuple[list[Expr], list[Stmt]]]
    other: list[Stmt]


@dataclass
class Endpoint(Stmt):
    path: str
    doc: str = ""
    accept: list = field(default_factory=list)
    buffer: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class Include(Stmt):
    path: str
