"""Search as a service would give it: validated requests, rounded answers."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pipeline import RetrievalPipeline

MAX_K = 100


class BadRequest(ValueError):
    """What a service answers with status 400."""


def search(pipeline: RetrievalPipeline, query: str, k: int = 5, where: dict[str, Any] | None = None) -> dict[str, Any]:
    if not query or not query.strip():
        raise BadRequest("the query is blank")
    if not 1 <= k <= MAX_K:
        raise BadRequest(f"k must be from 1 to {MAX_K}")
    began = time.perf_counter()
    hits = pipeline.search(query, k, where).collect()
    keys = ("rank", "chunk_id", "doc_id", "text", "metadata")
    return {
        "query": query,
        "latency_ms": round((time.perf_counter() - began) * 1000, 2),
        "hits": [{n: h[n] for n in keys} | {"score": round(h.score, 6)} for h in hits],
    }


def search_batch(pipeline: RetrievalPipeline, queries: DataFrame, k: int = 5, where: dict[str, Any] | None = None) -> DataFrame:
    """The same for a table of queries in one job; blank ones have no hits."""
    if not 1 <= k <= MAX_K:
        raise BadRequest(f"k must be from 1 to {MAX_K}")
    return pipeline.retrieve(queries, k, where).withColumn("score", F.round("score", 6))


def serve(pipeline: RetrievalPipeline, port: int = 8000, host: str = "127.0.0.1") -> HTTPServer:
    """An HTTP server (not started): GET /health, GET /search?q=&k=, POST /search."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict[str, Any]) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def reply(self, make) -> None:
            try:
                self.answer(200, make())
            except (ValueError, TypeError, KeyError) as e:
                self.answer(400, {"detail": str(e)})

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
            if url.path == "/health":
                self.answer(200, {"status": "ok", "chunks": pipeline.chunks.count()})
            elif url.path == "/search":
                self.reply(lambda: search(pipeline, asked.get("q", ""), int(asked.get("k", 5))))
            else:
                self.answer(404, {"detail": "not found"})

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))

            def make() -> dict[str, Any]:
                body = json.loads(raw)
                return search(pipeline, body.get("query", ""), int(body.get("k", 5)), body.get("where"))

            self.reply(make) if urlsplit(self.path).path == "/search" else self.answer(404, {"detail": "not found"})

        def log_message(self, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)
