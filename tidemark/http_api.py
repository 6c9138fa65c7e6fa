"""A small JSON interface: start a query, list queries, page through one's hits; and a page that uses it."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Row

from .engine import Engine
from .page import PAGE

DEFAULT_LIMIT = 100


def _plain(row: Row) -> dict:
    return {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in row.asDict().items()}


def list_queries(engine: Engine) -> list[dict]:
    return [_plain(r) for r in engine.results.list().collect()]


def show_query(engine: Engine, query_id: int, skip: int = 0, limit: int = DEFAULT_LIMIT) -> dict:
    """The query's metadata (null for an unknown id) and a page of its hits."""
    known = engine.results.list([query_id]).first()
    return {"query": known and _plain(known), "messages": [_plain(r) for r in engine.results.page(query_id, skip, limit).collect()]}


def start_query(engine: Engine, body: dict) -> dict:
    """Starts a search; hits are stored while the answer is already there. ``ValueError`` for bad input."""
    if not isinstance(body, dict) or not isinstance(body.get("query"), str):
        raise ValueError("query is missing")
    query_id = engine.submit(body["query"], body.get("fromDate"), body.get("toDate"), wait=False, pruning=body.get("pruning") or "prefix")
    return {"query": {"query_id": query_id, "text": body["query"], "finished": False}}


def server(engine: Engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """``serve_forever()`` answers ``GET /api/query``, ``GET /api/query/ID?skip=&limit=``, ``POST /api/query``, and ``GET /`` and ``GET /query/ID`` with a page."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, value: object) -> None:
            data = value.encode() if isinstance(value, str) else json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(value, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def tried(self, make) -> None:
            try:
                self.answer(200, make())
            except ValueError as e:
                self.answer(400, {"error": str(e)})
            except Exception as e:  # the client is told; the server goes on
                self.answer(500, {"error": type(e).__name__})

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
            if url.path == "/api/query":
                self.tried(lambda: list_queries(engine))
            elif m := re.fullmatch(r"/api/query/(\d+)", url.path):
                self.tried(lambda: show_query(engine, int(m[1]), int(asked.get("skip", 0)), int(asked.get("limit", DEFAULT_LIMIT))))
            elif url.path == "/" or re.fullmatch(r"/query/\d+", url.path):
                self.answer(200, PAGE)
            else:
                self.answer(404, {"error": "not found"})

        def do_POST(self) -> None:
            if urlsplit(self.path).path != "/api/query":
                return self.answer(404, {"error": "not found"})
            raw = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            self.tried(lambda: start_query(engine, json.loads(raw or b"null")))

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
