"""python -m weftgraph.cli COMMAND ...: every command of the service, as text or JSON."""

from __future__ import annotations

import argparse
import inspect
import os
import sys

from .api import UnknownSymbol, WrongKind
from .render import as_json, as_text
from .service import Service
from .store import ImportFailed

HOME = os.environ.get("WEFTGRAPH_HOME", "weftgraph-projects")


def parser(commands: dict) -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph")
    top.add_argument("--home", default=HOME, help="folder of projects")
    top.add_argument("--sources", help="folder of source files")
    top.add_argument("--json", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    for name, f in commands.items():
        p = sub.add_parser(name.replace("_", "-"))
        for arg, spec in inspect.signature(f).parameters.items():
            flag = arg.replace("_", "-")
            if spec.default is inspect.Parameter.empty:
                p.add_argument(arg)
            elif isinstance(spec.default, bool):
                p.add_argument(f"--{flag}", dest=arg, action=argparse.BooleanOptionalAction, default=spec.default)
            elif arg == "query":
                p.add_argument(arg, nargs="?")
            elif arg == "types":
                p.add_argument("--type", dest="types", action="append")
            else:
                p.add_argument(f"--{flag}", dest=arg, type=int if isinstance(spec.default, int) else str, default=spec.default)
    sub.add_parser("serve").add_argument("--http", type=int, help="port; without it, standard input and output")
    return top


def main(args: list[str] | None = None, service: Service | None = None) -> int:
    own = parser(Service(None, HOME).commands).parse_args(args)
    if service is None:
        from .session import session

        service = Service(session(), own.home, own.sources)
    given = {k: v for k, v in vars(own).items() if k not in ("home", "sources", "json", "command", "http")}
    if own.command == "serve":
        from .server import serve_http, serve_lines

        serve_http(service, own.http) if own.http else serve_lines(service, sys.stdin, sys.stdout)
        return 0
    try:
        result = service.commands[own.command.replace("-", "_")](**given)
    except (UnknownSymbol, WrongKind, ImportFailed) as e:
        print(as_json({"error": str(e)}) if own.json else f"Error: {e}", file=sys.stdout if own.json else sys.stderr)
        return 1
    print(as_json(result) if own.json else as_text(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
