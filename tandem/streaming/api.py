"""The HTTP API over findings and configs, on the standard library's server."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any

from tandem.functions.rules import RuleTypes
from tandem.plans.config import load_compare
from tandem.sources.findings import ElasticsearchStore, TableStore
from tandem.streaming import openapi
from tandem.streaming.control import FolderControl, KafkaControl


class ApiError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Raw:
    """An answer that is no JSON value of the API."""

    def __init__(self, kind: str, text: str):
        self.kind, self.text = kind, text


class Api:
    """Routes by method and path; each is called with the query's values and the body."""

    def __init__(self, store: TableStore | ElasticsearchStore, control: FolderControl | KafkaControl, types: RuleTypes | None = None):
        self.store, self.control, self.types = store, control, types or RuleTypes.standard()
        self.routes: dict[str, Callable[[dict[str, str], Any], Any]] = {
            "GET /api/health": lambda q, b: {"ok": True},
            "GET /api/rule-types": lambda q, b: self.types.catalogue(),
            "GET /api/config/active": lambda q, b: self.active(),
            "POST /api/config/validate": lambda q, b: self.validate(b),
            "POST /api/config/apply": lambda q, b: self.apply(b),
            "GET /api/verdicts": lambda q, b: self.found("verdict", q),
            "GET /api/rollups": lambda q, b: self.found("rollup", q),
            "GET /api/dead-letters": lambda q, b: self.found("dead-letter", q),
            "GET /api/summary": lambda q, b: self.summary(q),
            "GET /openapi.yaml": lambda q, b: Raw("application/yaml", json.dumps(openapi.document(), indent=2)),  # JSON is YAML
            "GET /docs": lambda q, b: Raw("text/html; charset=utf-8", openapi.page()),
        }

    def validate(self, body: Any) -> dict:
        if not isinstance(body, dict):
            return {"valid": False, "error": "request body must be a compare config object"}
        try:
            load_compare(body, self.types)
        except ValueError as e:
            return {"valid": False, "error": str(e)}
        return {"valid": True}

    @staticmethod
    def _limit(query: dict[str, str]) -> int:
        return int(query.get("limit", "100"))

    def found(self, kind: str, query: dict[str, str]) -> list[dict]:
        return self.store.values(kind, query.get("topic"), self._limit(query))

    def summary(self, query: dict[str, str]) -> dict:
        total, counts = self.store.counts(query.get("topic"), self._limit(query))
        return {"total": total, "counts": counts}

    def active(self) -> dict:
        text, source = self.control.active()
        return {"active": json.loads(text) if text else None, "source": source}

    def apply(self, body: Any) -> dict:
        if not isinstance(body, dict):
            raise ApiError(400, "request body must be a compare config object")
        self.control.apply(body)
        return {"applied": True}

    def answer(self, method: str, target: str, body: bytes) -> tuple[int, Any]:
        """Status and JSON of a request. Query values are taken as they stand."""
        path, _, raw = target.partition("?")
        route = self.routes.get(f"{method} {path}")
        if not route:
            return 404, {"error": f"no route for {method} {path}"}
        try:
            query = dict(p.partition("=")[::2] for p in raw.split("&") if p)
            return 200, route(query, json.loads(body) if body else None)
        except ApiError as e:
            return e.status, {"error": str(e)}
        except Exception as e:  # noqa: BLE001 - what goes wrong in a route is the caller's to see
            return 400, {"error": str(e)}


def serve(api: Api, port: int, threads: int = 8) -> HTTPServer:
    """A server with a fixed pool of threads and open CORS; run its serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, value: Any) -> None:
            raw = value if isinstance(value, Raw) else Raw("application/json", json.dumps(value))
            data = raw.text.encode()
            self.send_response(status)
            for name, text in (("Content-Type", raw.kind), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(name, text)
            self.end_headers()
            self.wfile.write(data)

        def _handle(self) -> None:
            self._send(*api.answer(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0))))

        do_GET = do_POST = _handle

        def do_OPTIONS(self) -> None:
            self._send(204, None)

        def log_message(self, *_: Any) -> None:
            pass

    class Pooled(HTTPServer):
        pool = ThreadPoolExecutor(threads)

        def process_request(self, request: Any, address: Any) -> None:
            self.pool.submit(self._work, request, address)

        def _work(self, request: Any, address: Any) -> None:
            try:
                self.finish_request(request, address)
            finally:
                self.shutdown_request(request)

    return Pooled(("", port), Handler)
