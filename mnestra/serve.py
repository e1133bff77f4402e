"""The engine for other programs: JSON over HTTP with a bearer key, and JSON-RPC tools over standard input and output."""

from __future__ import annotations

import hmac
import json
import os
import re
import sys
import threading
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO
from urllib.parse import parse_qs, unquote, urlsplit

from mnestra import schema
from mnestra.engine import MemoryEngine, lenient_time

#: A request's body is read up to this size.
MOST_BYTES = 16 << 20

_TEXT, _NUMBER, _LIST = {"type": "string"}, {"type": "number"}, {"type": "array", "items": {"type": "string"}}
#: Each tool's purpose, arguments, and those it can't do without.
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "mem_store": ("Keep a statement", {"content": _TEXT, "tags": _LIST, "importance": _NUMBER, "memory_type": {**_TEXT, "enum": list(schema.MEMORY_TYPES)}, "source_session": _TEXT}, ["content"]),
    "mem_recall": ("Find what helps with a question, put in order by the language model", {"query": _TEXT, "limit": _NUMBER, "filter_tags": _LIST, "since": _TEXT, "memory_type": _TEXT}, ["query"]),
    "mem_search": ("Find statements by meaning and words", {"query": _TEXT, "limit": _NUMBER, "filter_tags": _LIST}, ["query"]),
    "mem_update": ("Change a statement", {"id": _TEXT, "content": _TEXT, "importance": _NUMBER, "tags": _LIST}, ["id"]),
    "mem_forget": ("Delete, archive or weaken a statement", {"id": _TEXT, "mode": {**_TEXT, "enum": list(schema.FORGET_MODES)}}, ["id"]),
    "mem_consolidate": ("Draw lasting facts from a session", {"session_id": _TEXT}, ["session_id"]),
}


def list_tools() -> list[dict]:
    return [{"name": n, "description": what, "inputSchema": {"type": "object", "properties": given, "required": needed}} for n, (what, given, needed) in TOOLS.items()]


def plain(value: object) -> str:
    return json.dumps(value, default=str, ensure_ascii=False)


# -- JSON-RPC -------------------------------------------------------------------------------
def answer(engine: MemoryEngine, line: str) -> dict | None:
    """The answer to one line; None for a notification, which has no id. Codes: -32700 no JSON, -32600 no request, -32601 no such method, -32000 a tool failed."""
    failed = lambda id, code, why: {"jsonrpc": "2.0", "id": id, "error": {"code": code, "message": why}}
    try:
        request = json.loads(line)
    except ValueError as e:
        return failed(None, -32700, f"Parse error: {e}")
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return failed(None, -32600, "Invalid request")
    id, method = request.get("id"), request["method"]
    params = request.get("params") if isinstance(request.get("params"), dict) else {}
    if method.startswith("notifications/") and "id" not in request:
        return None
    if method == "initialize":
        result: object = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "mnestra", "version": "0.2.0"}}
    elif method.startswith("notifications/") or method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": list_tools()}
    elif method == "tools/call":
        arguments = params.get("arguments") if isinstance(params.get("arguments"), dict) else {}
        name = params.get("name")
        try:
            if name not in TOOLS:
                raise LookupError(f"no tool {name}")
            if missing := [a for a in TOOLS[name][2] if not isinstance(arguments.get(a), str)]:
                raise ValueError(f"missing {', '.join(missing)}")
            result = {"content": [{"type": "text", "text": plain(engine.call_tool(name, arguments))}]}
        except Exception as e:  # whatever a tool raises is told to the caller
            return failed(id, -32000, f"{type(e).__name__}: {e}")
    else:
        return failed(id, -32601, f"Method not found: {method}")
    return {"jsonrpc": "2.0", "id": id, "result": result}


def serve_stdio(engine: MemoryEngine, lines: Iterable[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    """A request a line until the input ends."""
    for line in lines:
        if line.strip() and (said := answer(engine, line)) is not None:
            out.write(plain(said) + "\n")
            out.flush()


# -- HTTP -----------------------------------------------------------------------------------
class HttpError(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def _checked(value: object, kind: type | tuple[type, ...], name: str, needed: bool = False) -> object:
    if value is None and not needed:
        return None
    if not isinstance(value, kind) or isinstance(value, bool):
        raise HttpError(400, f"{name} is missing or of a wrong type")
    return value


def _tags(text: str | None) -> list[str]:
    return [t.strip() for t in text.split(",")] if text is not None else []


class Api:
    """What each address does; every function gives a status and a value."""

    def __init__(self, engine: MemoryEngine):
        self.engine, self.lock = engine, threading.Lock()
        self.routes: list[tuple[str, re.Pattern, Callable]] = [
            ("POST", re.compile(r"/v1/memories"), self.store),
            ("GET", re.compile(r"/v1/memories/recall"), self.recall),
            ("GET", re.compile(r"/v1/memories/search"), self.search),
            ("PATCH", re.compile(r"/v1/memories/([^/]+)"), self.update),
            ("DELETE", re.compile(r"/v1/memories/([^/]+)"), self.forget),
            ("POST", re.compile(r"/v1/sessions/([^/]+)/consolidate"), self.consolidate),
        ]

    def call(self, method: str, path: str, query: dict[str, str], body: dict) -> tuple[int, object]:
        for verb, pattern, run in self.routes:
            if verb == method and (m := pattern.fullmatch(path)):
                if method == "GET":
                    return run(query, body, *map(unquote, m.groups()))
                with self.lock:  # one write after another
                    return run(query, body, *map(unquote, m.groups()))
        raise HttpError(404, "no such address")

    def store(self, query: dict, body: dict) -> tuple[int, object]:
        content, importance = _checked(body.get("content"), str, "content", True), _checked(body.get("importance"), (int, float), "importance")
        tags, ttl = _checked(body.get("tags"), list, "tags"), _checked(body.get("ttl_days"), int, "ttl_days")
        id = self.engine.store(content, importance is None, importance=importance, tags=[str(t) for t in tags or []], memory_type=_checked(body.get("memory_type"), str, "memory_type"), ttl_days=ttl, source_session=_checked(body.get("source_session"), str, "source_session"))
        row = self.engine.get(id).first()
        return 201, {c: row[c] for c in ("id", "importance", "tags", "created_at")}

    def _limit(self, query: dict, default: int) -> int:
        if not query.get("limit", str(default)).isdigit():
            raise HttpError(400, "limit is no number")
        return int(query.get("limit", default))

    def recall(self, query: dict, body: dict) -> tuple[int, object]:
        kind = (query.get("memory_type") or "").lower()
        found = self.engine.recall(_checked(query.get("q"), str, "q", True), self._limit(query, schema.RECALL_LIMIT), _tags(query.get("filter_tags")), lenient_time(query.get("since")), kind if kind in schema.MEMORY_TYPES else None)
        return 200, [r.asDict() for r in found.orderBy("rank").collect()]

    def search(self, query: dict, body: dict) -> tuple[int, object]:
        found = self.engine.search(_checked(query.get("q"), str, "q", True), self._limit(query, schema.SEARCH_LIMIT), _tags(query.get("filter_tags")))
        return 200, [r.asDict() for r in found.orderBy("rank").collect()]

    def update(self, query: dict, body: dict, id: str) -> tuple[int, object]:
        tags = _checked(body.get("tags"), list, "tags")
        try:
            self.engine.update(id, _checked(body.get("content"), str, "content"), _checked(body.get("importance"), (int, float), "importance"), [str(t) for t in tags] if tags is not None else None)
        except KeyError:
            raise HttpError(404, f"no memory {id}") from None
        row = self.engine.get(id).first()
        return 200, {c: row[c] for c in ("id", "content", "importance", "tags", "updated_at")}

    def forget(self, query: dict, body: dict, id: str) -> tuple[int, object]:
        return 200, {"success": self.engine.forget(id, query.get("mode", "delete"))}

    def consolidate(self, query: dict, body: dict, session: str) -> tuple[int, object]:
        return 200, self.engine.call_tool("mem_consolidate", {"session_id": session})


def http_server(engine: MemoryEngine, host: str = "127.0.0.1", port: int = 3000, key: str | None = None) -> ThreadingHTTPServer:
    """A server that isn't started yet. With a key, by default that of ``MNESTRA_API_KEY``, all but ``/health`` asks for it; without one only this machine is served."""
    api, key = Api(engine), key if key is not None else os.environ.get("MNESTRA_API_KEY")
    if not key and host not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError("serving other machines needs a key in MNESTRA_API_KEY")

    class Handler(BaseHTTPRequestHandler):
        def run(self) -> None:
            try:
                status, value = self.reply()
            except HttpError as e:
                status, value = e.status, {"error": str(e)}
            except Exception as e:  # the engine's errors are told to the caller
                status, value = 500, {"error": f"{type(e).__name__}: {e}"}
            data = (value if isinstance(value, str) else plain(value)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(value, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PATCH = do_DELETE = run

        def reply(self) -> tuple[int, object]:
            size = self.headers.get("Content-Length", "0")
            if not size.isdigit() or int(size) > MOST_BYTES:
                self.close_connection = True
                raise HttpError(413 if size.isdigit() else 400, "body too large or of no length")
            raw, at = self.rfile.read(int(size)), urlsplit(self.path)
            if self.command == "GET" and at.path == "/health":
                return 200, "ok"
            if key and not hmac.compare_digest(self.headers.get("Authorization", "").encode(), f"Bearer {key}".encode()):
                raise HttpError(401, "Invalid API key")
            try:
                body = json.loads(raw or b"{}")
            except ValueError:
                raise HttpError(400, "body is no JSON") from None
            if not isinstance(body, dict):
                raise HttpError(400, "body is no object")
            return api.call(self.command, at.path, {k: v[-1] for k, v in parse_qs(at.query, keep_blank_values=True).items()}, body)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
