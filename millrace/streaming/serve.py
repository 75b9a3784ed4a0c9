"""The HTTP host: one route for each script with an endpoint, and flushers for the ones with a buffer."""

from __future__ import annotations

import dataclasses
import json
import os
import signal
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from ..errors import PlanError, is_transient
from ..lang import ast as A
from ..runtime import Engine, Run, included, show
from ..sources import body
from . import wal

MOST_BODY = 64 << 20


@dataclasses.dataclass
class Route:
    path: str
    script: str
    source: str
    statements: list[A.Stmt]
    endpoint: A.Endpoint
    buffer: wal.Buffer | None = None
    flush: tuple[float | None, int | None] = (None, None)

    def params(self) -> list[str]:
        return [s.name for s in self.statements if isinstance(s, A.ParamDef) and s.origin in (None, "query") and s.type.kind != "json"]


def _buffer_source(statements: list[A.Stmt]) -> A.Source | None:
    for s in statements:
        if isinstance(s, A.Output):
            for b in s.query.branches:
                if b.source.kind == "buffer":
                    return b.source
    return None


class Host:
    def __init__(self, spark: SparkSession, directory: str, run: Run | None = None, watch: bool = False):
        self.spark, self.directory, self.base, self.watch = spark, directory, run or Run(), watch
        self.routes: dict[str, Route] = {}
        self.buffers: dict[str, wal.Buffer] = {}
        self.stop = threading.Event()
        self.seen: dict[str, float] = {}
        self.load()

    def load(self) -> None:
        """Reads all scripts anew. A bad one keeps the routes as they were."""
        routes, seen = {}, {}
        for name in sorted(os.listdir(self.directory)):
            if not name.endswith(".sql"):
                continue
            path = os.path.join(self.directory, name)
            seen[path] = os.path.getmtime(path)
            with open(path, encoding="utf-8") as f:
                source = f.read()
            statements = included(source, path)
            e = next((s for s in statements if isinstance(s, A.Endpoint)), None)
            if e is None:
                continue
            if e.path in routes:
                raise PlanError(f"{name}: the route {e.path} is taken", e.at)
            route = Route(e.path, path, source, statements, e)
            if e.buffer:
                root = os.path.join(self.base.root, e.options.get("at", self.directory), e.buffer)
                if root not in self.buffers:
                    o = e.options
                    self.buffers[root] = wal.Buffer(root, o.get("segment_bytes", 64 << 20), o.get("max_bytes", 1 << 30), o.get("retain", "loaded"), o.get("retain_seconds"))
                route.buffer = self.buffers[root]
                source_ = _buffer_source(statements)
                route.flush = source_.flush if source_ else (5.0, None)
            routes[e.path] = route
        self.routes, self.seen = routes, seen

    def changed(self) -> bool:
        now = {os.path.join(self.directory, n): os.path.getmtime(os.path.join(self.directory, n)) for n in os.listdir(self.directory) if n.endswith(".sql")}
        return now != self.seen

    # -- requests
    def handle(self, path: str, query: dict[str, str], headers: dict[str, str], raw: bytes) -> tuple[int, dict, dict]:
        """Status, JSON answer and headers."""
        if path == "/healthz":
            return 200, {"ok": True}, {}
        if path == "/readyz":
            ready = bool(self.routes)
            return (200 if ready else 503), {"ok": ready, "routes": sorted(self.routes)}, {}
        route = self.routes.get(path)
        if route is None:
            return 404, {"error": "no such endpoint"}, {}
        if len(raw) > MOST_BODY:
            return 413, {"error": "the body is too large"}, {}
        try:
            if route.buffer is not None:
                rows = body.validated(raw, route.endpoint.accept)
                names = [n for n, _, _ in route.endpoint.accept]
                route.buffer.append([dict(zip(names, r, strict=True)) for r in rows])
                return 200, {"accepted": len(rows)}, {}
            known = set(route.params())
            run = dataclasses.replace(self.base, params={k: v for k, v in query.items() if k in known}, headers=headers, request_body=raw or None)
            results = Engine(self.spark, run).run(route.source, route.script)
            failed = [r for r in results if r.error is not None]
            answer: dict = {"outputs": len(results) - len(failed)}
            rows = [json.loads(line) for r in results if r.df is not None for line in show(r, "json")]
            if any(r.df is not None for r in results):
                answer["rows"] = rows
            if failed:
                return 207, answer | {"errors": [str(r.error) for r in failed]}, {}
            return 200, answer, {}
        except wal.Full as e:
            return 503, {"error": str(e)}, {"Retry-After": "5"}
        except (PlanError, body.Invalid) as e:
            return 422, {"error": str(e)}, {}
        except Exception as e:  # noqa: BLE001  the host outlives every request
            if is_transient(e):
                return 503, {"error": str(e)}, {"Retry-After": "5"}
            return 422, {"error": str(e)}, {}

    # -- buffers
    def drain(self, route: Route) -> int:
        """Loads what is closed, a segment at a time; a segment's label is the same at every try. How many were loaded."""
        done = 0
        for segment in route.buffer.pending():
            run = dataclasses.replace(self.base, segment=segment, label=wal.label(route.buffer.root, segment), params={}, request_body=None)
            Engine(self.spark, run).run(route.source, route.script)
            route.buffer.mark_loaded(segment)
            done += 1
        return done

    def flusher(self) -> None:
        while not self.stop.wait(0.5):
            if self.watch and self.changed():
                self.reload()
            for route in list(self.routes.values()):
                if route.buffer is None:
                    continue
                try:
                    if route.buffer.due(*route.flush):
                        route.buffer.rotate()
                    self.drain(route)
                except Exception as e:  # noqa: BLE001  the segment stays, and is tried again
                    self.base.log(f"flush of {route.path}: {e}")
                    time.sleep(1)

    def reload(self) -> None:
        try:
            self.load()
        except Exception as e:  # noqa: BLE001  a bad script must not stop the good ones
            self.base.log(f"reload: {e}")

    def server(self, host: str, port: int) -> ThreadingHTTPServer:
        owner = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self) -> None:
                parts = urllib.parse.urlsplit(self.path)
                size = int(self.headers.get("Content-Length") or 0)
                raw = self.rfile.read(min(size, MOST_BODY + 1)) if size else b""
                status, answer, headers = owner.handle(parts.path, dict(urllib.parse.parse_qsl(parts.query)), dict(self.headers), raw)
                data = json.dumps(answer, ensure_ascii=False).encode()
                self.send_response(status)
                for k, v in ({"Content-Type": "application/json", "Content-Length": str(len(data))} | headers).items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_PUT = _answer

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)

    def serve(self, host: str = "127.0.0.1", port: int = 8080) -> None:
        if threading.current_thread() is threading.main_thread() and hasattr(signal, "SIGHUP"):
            signal.signal(signal.SIGHUP, lambda *_: self.reload())
        flusher = threading.Thread(target=self.flusher, daemon=True)
        flusher.start()
        server = self.server(host, port)
        try:
            server.serve_forever()
        finally:
            self.stop.set()
            server.server_close()


__all__ = ["Host", "Route"]
