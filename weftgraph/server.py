"""A tool server: JSON-RPC 2.0 over lines or HTTP."""

from __future__ import annotations

import inspect
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from .render import as_json
from .service import SERVER_LIMIT, Service

# JSON-RPC's error codes.
PARSE, METHOD, PARAMS, FAILED = -32700, -32601, -32602, -32000
PROTOCOL = "2024-11-05"


def tools(service: Service) -> list[dict]:
    kinds = {int: "integer", bool: "boolean", str: "string"}
    out = []
    for name, f in service.commands.items():
        properties, required = {}, []
        for arg, spec in inspect.signature(f).parameters.items():
            kind = "array" if arg == "types" else kinds.get(type(spec.default), "string")
            properties[arg] = {"type": kind} | ({"items": {"type": "string"}} if kind == "array" else {})
            if spec.default is inspect.Parameter.empty:
                required.append(arg)
        out.append({"name": name, "description": (inspect.getdoc(f) or name.replace("_", " ")).split("\n")[0], "inputSchema": {"type": "object", "properties": properties, "required": required}})
    return out


def count(entries: list[dict]) -> int:
    return sum(1 + count(e.get("children", [])) for e in entries)


def answer(service: Service, request: object) -> dict | None:
    """The response to one request; None for a notification."""
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "Invalid request"}}
    key, method, params = request.get("id"), request["method"], request.get("params") or {}
    fail = lambda code, text: {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": text}}
    if key is None:
        return None
    if method == "initialize":
        result: object = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "weftgraph", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": tools(service)}
    elif method == "tools/call":
        f = service.commands.get(params.get("name"))
        if f is None:
            return fail(METHOD, f"Unknown tool: {params.get('name')}")
        given = params.get("arguments") or {}
        known = inspect.signature(f).parameters
        if unknown := set(given) - set(known):
            return fail(PARAMS, f"Unknown arguments: {', '.join(sorted(unknown))}")
        if "limit" in known:
            given = {"limit": SERVER_LIMIT} | given
        try:
            got = f(**given)
        except Exception as e:  # noqa: BLE001 - the caller gets every failure as a response
            return fail(FAILED, str(e))
        if "tree" in got:
            got = got | {"total": count(got["tree"])}
        result = {"content": [{"type": "text", "text": as_json(got)}]}
    else:
        return fail(METHOD, f"Unknown method: {method}")
    return {"jsonrpc": "2.0", "id": key, "result": result}


def serve_lines(service: Service, source: TextIO, sink: TextIO) -> None:
    for text in source:
        if not text.strip():
            continue
        try:
            out = answer(service, json.loads(text))
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "Parse error"}}
        if out is not None:
            print(json.dumps(out, ensure_ascii=False, default=str), file=sink, flush=True)


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: object = None) -> None:
            data = b"" if body is None else json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:  # noqa: N802
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw)
            except ValueError:
                return self._send(400, {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "Parse error"}})
            if isinstance(body, list):
                out = [r for r in (answer(service, x) for x in body) if r is not None]
                return self._send(200, out) if out else self._send(202)
            out = answer(service, body)
            return self._send(202) if out is None else self._send(200, out)

        def do_GET(self) -> None:  # noqa: N802
            self._send(200, {"status": "ok"}) if self.path == "/health" else self._send(405)

        def do_DELETE(self) -> None:  # noqa: N802
            self._send(204)

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def serve_http(service: Service, port: int, host: str = "127.0.0.1") -> None:
    ThreadingHTTPServer((host, port), handler(service)).serve_forever()
