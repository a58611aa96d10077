"""Thin HTTP adapter over :class:`SearchEngine`: POST /search, POST /search/objects, GET /strategies, GET /health."""

from __future__ import annotations

import json
import logging
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .engine import SearchEngine, strategies
from .operators import held
from .sources import corpus as io

LOG = logging.getLogger(__name__)


class App:
    """Requests as plain data, so that they can be tested without a socket."""

    def __init__(self, spark: SparkSession, model_path: str | None = None):
        self.spark, self.model_path, self.engines = spark, model_path, {}

    def engine(self, strategy: str) -> SearchEngine:
        """The engine of a strategy; it keeps nothing of the corpora that it searches."""
        if strategy not in self.engines:
            self.engines[strategy] = SearchEngine(self.spark, strategy, model_path=self.model_path)
        return self.engines[strategy]

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        """Status and answer; bad requests are 422, unknown paths 404."""
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok"}
        if (method, path) == ("GET", "/strategies"):
            return 200, {"strategies": strategies()}
        if method != "POST" or path not in ("/search", "/search/objects"):
            return 404, {"error": "not found"}
        body = body or {}
        try:
            query, k, strategy = str(body["query"]), int(body.get("top_k", 10)), body.get("strategy", "cascade")
            engine = self.engine(strategy)
            start = time.perf_counter()
            if path == "/search":
                items = io.need_strings(body["documents"])
                rows = engine.search(query, items, k).collect() if items else []
            else:
                items = body["objects"]
                rows = engine.search_objects(query, io.from_objects(self.spark, items), body["text_fields"], k).collect() if items else []
            took = (time.perf_counter() - start) * 1000
            held.release()
        except (KeyError, TypeError, ValueError) as e:
            return 422, {"error": str(e)}
        answer = io.response(query, engine.strategy, rows, len(items), took, digits=None)
        if path == "/search/objects":
            for r in answer["results"]:
                r["object"] = items[r["index"]]
        answer.pop("query")
        return 200, answer


def serve(spark: SparkSession, host: str, port: int, model_path: str | None = None, origin: str | None = None) -> None:
    """Serve until interrupted; ``origin`` is answered as the allowed origin of cross-site requests.  Each request's time is logged."""
    app = App(spark, model_path)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            start = time.perf_counter()
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, data = app.handle(method, self.path, json.loads(raw) if raw else None)
            except json.JSONDecodeError as e:
                status, data = 422, {"error": str(e)}
            out = json.dumps(data).encode()
            LOG.info("%s %s %d %.1f ms", method, self.path, status, (time.perf_counter() - start) * 1000)
            self.send_response(status)
            if origin:
                self.send_header("Access-Control-Allow-Origin", origin)
                self.send_header("Access-Control-Allow-Headers", "Content-Type")
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            if origin:
                self.send_header("Access-Control-Allow-Origin", origin)
                self.send_header("Access-Control-Allow-Methods", "GET, POST")
                self.send_header("Access-Control-Allow-Headers", "Content-Type")
            self.end_headers()

        def log_message(self, *args) -> None:
            """Requests are logged with their time instead."""

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

    ThreadingHTTPServer((host, port), Handler).serve_forever()
