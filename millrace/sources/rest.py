"""REST APIs: pages of JSON rows, with retries, authentication and the usual three kinds of pagination.

The first page is read while planning, for its columns. Where the API tells the number of rows, the other pages are dealt out
to tasks; else they are read in turn, or ``prefetch`` at a time, into a file of the shared folder.
"""

from __future__ import annotations

import base64
import json
import os
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import PlanError, RunError
from ..lang import ast as A
from .files import scratch

RETRYABLE = (429, 500, 502, 503, 504)


@dataclass
class Request:
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    method: str = "GET"
    body: str | None = None
    items: str | None = None
    timeout: float = 60.0
    retries: int = 0
    retry_on: tuple[int, ...] = RETRYABLE
    paginate: tuple[str, dict] | None = None
    login: dict | None = None


def dotted(doc: object, path: str | None) -> object:
    for p in path.split(".") if path else ():
        doc = doc.get(p) if isinstance(doc, dict) else None
    return doc


def login(r: Request) -> dict[str, str]:
    """Headers of a fresh token, by a JSON login or OAuth2 client credentials."""
    o = r.login or {}
    if o.get("auth") == "login_json":
        body = json.dumps({o.get("user_field", "username"): o.get("user"), o.get("pass_field", "password"): o.get("password")}).encode()
        request = urllib.request.Request(o["login_url"], body, {"Content-Type": "application/json"})
    else:
        form = {"grant_type": "client_credentials", "client_id": o.get("client_id"), "client_secret": o.get("client_secret")} | ({"scope": o["scope"]} if o.get("scope") else {})
        request = urllib.request.Request(o["token_url"], urllib.parse.urlencode(form).encode())
    with urllib.request.urlopen(request, timeout=r.timeout) as f:
        doc = json.load(f)
    token = dotted(doc, o.get("token_field", "token" if o.get("auth") == "login_json" else "access_token"))
    if not token:
        raise RunError("the login answered without a token")
    return {o.get("token_header", "Authorization"): f"{o.get('token_prefix', 'Bearer ')}{token}"}


def fetch(r: Request, url: str) -> object:
    """One page as JSON. Busy answers are tried again with growing, jittered pauses; a 401 logs in once more."""
    headers = dict(r.headers) | (login(r) if r.login else {})
    again = bool(r.login)
    for attempt in range(r.retries + 1):
        try:
            request = urllib.request.Request(url, r.body.encode() if r.body else None, headers | {"Accept": "application/json"}, method=r.method)
            with urllib.request.urlopen(request, timeout=r.timeout) as f:
                return json.load(f)
        except urllib.error.HTTPError as e:
            if e.code == 401 and again:
                headers, again = headers | login(r), False
                continue
            if e.code not in r.retry_on or attempt == r.retries:
                raise RunError(f"{url}: HTTP {e.code}", transient=e.code in RETRYABLE) from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt == r.retries:
                raise RunError(f"{url}: {e}", transient=True) from e
        except json.JSONDecodeError as e:
            raise RunError(f"{url}: the answer is no JSON") from e
        time.sleep(min(30.0, 0.2 * 2**attempt) * random.uniform(0.5, 1.0))
    raise RunError(f"{url}: no answer", transient=True)


def rows_of(doc: object, items: str | None) -> list[dict]:
    found = dotted(doc, items)
    if isinstance(found, dict):
        found = [found]
    if found is None and items is None:
        found = []
    if not isinstance(found, list):
        raise RunError(f"the answer has no list of rows{f' at {items}' if items else ''}; name it with WITH (items = ...)")
    return [x for x in found if isinstance(x, dict)]


def with_query(url: str, **values: object) -> str:
    parts = urllib.parse.urlsplit(url)
    query = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k not in values]
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode([*query, *values.items()])))


def page_url(r: Request, page: int) -> str:
    kind, o = r.paginate
    size = o.get("size")
    if kind == "page":
        extra = {o.get("param", "page"): int(o.get("start", 1)) + page}
    else:
        extra = {o.get("param", "offset"): int(o.get("start", 0)) + page * int(size or 100)}
    if size is not None:
        extra[o.get("size_param", "limit" if kind == "offset" else "per_page")] = size
    return with_query(r.url, **extra)


def pages(r: Request, first: int = 0, last: int | None = None) -> Iterator[object]:
    """Pages in turn, until one is empty or short, the cursor ends, or ``max`` of them are read."""
    if r.paginate is None:
        yield fetch(r, r.url)
        return
    kind, o = r.paginate
    most = int(o["max"]) if "max" in o else None
    size = int(o["size"]) if "size" in o else None
    ahead = int(o.get("prefetch", 0)) if kind != "cursor" else 0
    if ahead > 1:
        yield from fetched_ahead(r, first, last if last is not None else most, size, ahead)
        return
    url, n = (r.url if kind == "cursor" else page_url(r, first)), first
    if kind == "cursor" and size is not None:
        url = with_query(url, **{o.get("size_param", "limit"): size})
    while (most is None or n < most) and (last is None or n < last):
        doc = fetch(r, url)
        rows = rows_of(doc, r.items)
        if not rows and n > first:
            return
        yield doc
        n += 1
        if kind == "cursor":
            cursor = dotted(doc, o.get("field", "next"))
            if not cursor:
                return
            url = str(cursor) if str(cursor).startswith("http") else with_query(r.url, **{o.get("param", "cursor"): cursor})
        else:
            total = dotted(doc, o["total"]) if "total" in o else None
            if size is not None and len(rows) < size or not rows or total is not None and size and n * size >= int(total):
                return
            url = page_url(r, n)


def fetched_ahead(r: Request, first: int, last: int | None, size: int | None, ahead: int) -> Iterator[object]:
    """Numbered pages in turn, with the next ``ahead`` ones on their way."""
    total_at = r.paginate[1].get("total")
    with ThreadPoolExecutor(ahead) as pool:
        asked: deque = deque()
        n = first
        while True:
            while len(asked) < ahead and (last is None or n < last):
                asked.append(pool.submit(fetch, r, page_url(r, n)))
                n += 1
            if not asked:
                return
            doc = asked.popleft().result()
            rows = rows_of(doc, r.items)
            seen = n - len(asked)
            total = dotted(doc, total_at) if total_at else None
            if rows or seen == first + 1:
                yield doc
            if not rows or size is not None and len(rows) < size or total is not None and size and seen * size >= int(total):
                for f in asked:
                    f.cancel()
                return


def inferred(rows: list[dict]) -> T.StructType:
    """Columns and types by the first row; all nullable."""
    if not rows:
        return T.StructType()
    kind = lambda v: T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
    return T.StructType([T.StructField(k, kind(v), True) for k, v in rows[0].items()])


def coerce(row: dict, schema: T.StructType) -> tuple:
    """A row under the columns: what is missing is null, what is new is dropped, values take the columns' types."""
    out = []
    for f in schema.fields:
        v = row.get(f.name)
        try:
            if v is None:
                pass
            elif isinstance(f.dataType, T.StringType):
                v = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
            elif isinstance(f.dataType, T.BooleanType):
                v = v if isinstance(v, bool) else {"true": True, "false": False}[str(v).lower()]
            elif isinstance(f.dataType, T.LongType):
                v = int(v)
            elif isinstance(f.dataType, T.DoubleType):
                v = float(v)
        except (ValueError, KeyError, TypeError) as e:
            raise RunError(f"field {f.name!r}: {v!r} is no {f.dataType.simpleString()}") from e
        out.append(v)
    return tuple(out)


def request_of(url: str, s: A.Source, options: dict) -> Request:
    """A source's clauses and its connection's options as a request."""
    o = {**options, **s.options}
    headers = {}
    for k, v in o.items():
        if k == "header" or k.startswith("header_"):
            name, sep, value = str(v).partition(":")
            if not sep:
                raise PlanError("header = 'Name: value'")
            headers[name.strip()] = value.strip()
    auth = o.get("auth", "none")
    if auth == "bearer":
        headers["Authorization"] = f"Bearer {o.get('token', '')}"
    elif auth == "basic":
        headers["Authorization"] = "Basic " + base64.b64encode(f"{o.get('user', '')}:{o.get('password', '')}".encode()).decode()
    elif auth not in ("none", "header", "login_json", "oauth2"):
        raise PlanError(f"auth {auth!r} is not supported")
    body = o.get("body")
    if body:
        headers.setdefault("Content-Type", "application/json")
    n, on = s.retry or (0, ())
    return Request(url, headers, str(o.get("method", "POST" if body else "GET")).upper(), body, o.get("items"), float(o.get("timeout_ms", 60_000)) / 1000, n, on or RETRYABLE, s.paginate, o if auth in ("login_json", "oauth2") else None)


def read(spark: SparkSession, r: Request) -> DataFrame:
    stream = pages(r)
    first = next(stream, None)
    got = rows_of(first, r.items) if first is not None else []
    schema = inferred(got)
    if not schema.fields:
        return spark.createDataFrame([], T.StructType())
    head = spark.createDataFrame([coerce(x, schema) for x in got], schema)
    if r.paginate is None:
        return head
    kind, o = r.paginate
    size = int(o["size"]) if "size" in o else len(got)
    total = dotted(first, o["total"]) if kind != "cursor" and "total" in o else None
    if total is not None:
        last = -(-int(total) // max(size, 1))
        last = min(last, int(o["max"])) if "max" in o else last
        if last <= 1:
            return head

        def read_pages(batches):
            import pyarrow as pa

            for b in batches:
                for page in b.column(0).to_pylist():
                    rows = [coerce(x, schema) for x in rows_of(fetch(r, page_url(r, page)), r.items)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), _arrow(f.dataType)) for c, f in zip(zip(*rows, strict=True), schema.fields, strict=True)], names=schema.names)

        rest = spark.range(1, last, 1, min(last - 1, 64)).mapInArrow(read_pages, schema)
        return head.union(rest)
    # How many pages there are shows at the last one: they go to a file of the shared folder as they come, one in memory at a time.
    path, n = os.path.join(scratch(spark), "pages.json"), 0
    with open(path, "w", encoding="utf-8") as f:
        for doc in stream:
            for x in rows_of(doc, r.items):
                f.write(json.dumps(dict(zip(schema.names, coerce(x, schema), strict=True)), ensure_ascii=False) + "\n")
                n += 1
    return head.union(spark.read.schema(schema).option("mode", "FAILFAST").json(path)) if n else head


def _arrow(t: T.DataType):
    import pyarrow as pa

    return {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}.get(t.typeName(), pa.string())
