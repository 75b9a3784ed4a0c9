"""``python -m millrace``: run, check, serve and repl."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .errors import PlanError
from .runtime import Engine, Run, exit_code, show

HELP = ".help .quit .connections .functions .set NAME VALUE"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("millrace", description="A SQL data-movement engine on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "check", "serve", "repl"):
        s = sub.add_parser(name)
        s.add_argument("-p", "--param", action="append", default=[], metavar="NAME=VALUE")
        s.add_argument("-j", "--jobs", type=int, default=os.cpu_count() or 4)
        s.add_argument("-q", "--quiet", action="store_true")
        s.add_argument("--format", choices=("table", "json"), default="table")
        s.add_argument("--log-format", choices=("text", "json"), default="text")
        s.add_argument("--log-level", choices=("error", "warn", "info", "debug"), default="warn")
        if name in ("run", "check"):
            s.add_argument("-c", "--command", dest="text")
            s.add_argument("script", nargs="?")
        if name == "serve":
            s.add_argument("directory")
            s.add_argument("--host", default="127.0.0.1")
            s.add_argument("--port", type=int, default=8080)
            s.add_argument("--watch", action="store_true")
    return p.parse_args(argv)


def params(given: list[str]) -> dict[str, str]:
    out = {}
    for x in given:
        name, sep, value = x.partition("=")
        if not sep or not name:
            raise PlanError(f"-p takes NAME=VALUE, not {x!r}")
        out[name] = value
    return out


def logger(form: str):
    def log(text: str) -> None:
        print(json.dumps({"level": "info", "msg": text}, ensure_ascii=False) if form == "json" else text, file=sys.stderr)

    return log


def repl(engine: Engine, form: str) -> int:
    held = ""
    while True:
        try:
            line = input("... " if held else "> ")
        except EOFError:
            return 0
        if not held and line.startswith("."):
            word, *rest = line.split()
            if word == ".quit":
                return 0
            if word == ".set" and len(rest) == 2:
                engine.run_.params[rest[0]] = rest[1]
            elif word == ".connections":
                print("\n".join(f"{c.name} {c.type}" for c in engine.connections.values()))
            elif word == ".functions":
                print("\n".join(sorted(engine.functions)))
            else:
                print(HELP)
            continue
        held += line + "\n"
        if not line.rstrip().endswith(";"):
            continue
        try:
            for r in engine.run(held, "input"):
                print("\n".join(show(r, form)))
        except Exception as e:  # noqa: BLE001  a session goes on after whatever failed
            print(f"error: {e}", file=sys.stderr)
        held = ""


def main(argv: list[str] | None = None) -> int:
    from . import session

    a = arguments(argv)
    try:
        run = Run(params=params(a.param), jobs=a.jobs, quiet=a.quiet, check=a.command == "check", log=logger(a.log_format))
        if a.command == "serve":
            from .streaming.serve import Host

            Host(session.local(a.jobs), a.directory, run, a.watch).serve(a.host, a.port)
            return 0
        if a.command == "repl":
            return repl(Engine(session.local(a.jobs), run), a.format)
        if a.text is not None:
            source, name = a.text, "command"
        elif a.script in (None, "-"):
            source, name = sys.stdin.read(), "input"
        else:
            name = a.script
            with open(a.script, encoding="utf-8") as f:
                source = f.read()
        failed = None
        for r in Engine(session.local(a.jobs), run).run(source, name):
            failed = failed or r.error
            if r.error is not None:
                print(f"error: {r.error}", file=sys.stderr)
            elif a.command == "run":
                for line in show(r, a.format):
                    print(line)
        return exit_code(failed)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  every failure has an exit code
        print(f"error: {e}", file=sys.stderr)
        return exit_code(e)
