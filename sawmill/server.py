"""A thin HTTP front end over the engine: query, ingest, indices, health and metrics.

It holds no data: every request is one call of the functions that the library offers. Requests
wait for one of ``workers`` places; more than ``max_pending`` of them are refused.
"""

from __future__ import annotations

import json
import os
import threading
from dataclasses import dataclass, fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession

from .operators import search
from .plans import engine
from .plans.ast import QueryError
from .plans.command import size_bytes
from .sources.store import Catalog, StoreError
from .streaming import ingest


@dataclass
class ServerConfig:
    """Limits of the front end. Sizes accept ``64m`` and the like."""

    data_root: str = "data"
    host: str = "127.0.0.1"
    port: int = 8080
    workers: int = 4
    max_pending: int = 64
    max_body: int = 64 << 20
    max_header: int = 16 << 10
    timeout_s: int = 60

    @classmethod
    def load(cls, text: str = "", env: dict[str, str] | None = None) -> "ServerConfig":
        """``name = value`` lines (``#`` begins a comment); SAWMILL_<NAME> in the environment wins."""
        given = {}
        for line in text.splitlines():
            name, eq, value = line.split("#", 1)[0].partition("=")
            if eq:
                given[name.strip().lower()] = value.strip()
        given |= {k.lower().removeprefix("sawmill_"): v for k, v in (env or {}).items() if k.lower().startswith("sawmill_")}
        out = cls()
        for f in fields(cls):
            if f.name in given:
                setattr(out, f.name, given[f.name] if f.type == "str" else size_bytes(given[f.name]))
        return out


class Refused(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


class Service:
    """What the requests ask for, apart from HTTP."""

    def __init__(self, spark: SparkSession, config: ServerConfig):
        self.spark, self.config = spark, config
        self.catalog = Catalog(spark, config.data_root)
        self.engine = engine.Engine(self.catalog)
        self.places = threading.BoundedSemaphore(config.workers)
        self.lock, self.pending = threading.Lock(), 0

    def enter(self) -> None:
        with self.lock:
            if self.pending >= self.config.workers + self.config.max_pending:
                raise Refused(503, "busy")
            self.pending += 1
        self.places.acquire()

    def leave(self) -> None:
        self.places.release()
        with self.lock:
            self.pending -= 1

    def query(self, args: dict[str, str]) -> str:
        index, text = args.get("index", ""), args.get("q", "")
        if not index or not text:
            raise Refused(400, "missing index or q")
        limit = int(args.get("limit") or search.DEFAULT_LIMIT)
        out = self.engine.query(index, text, limit)
        return engine.render(out, engine.plan(text)[1], args.get("pretty", "") in ("1", "true"))

    def bulk(self, args: dict[str, str], body: bytes) -> str:
        if not args.get("index"):
            raise Refused(400, "missing index")
        self.catalog.path(args["index"])
        rows = [(x,) for x in body.decode("utf-8", "replace").split("\n")]
        return json.dumps(ingest.bulk(self.catalog, args["index"], self.spark.createDataFrame(rows, "raw string")))

    def indices(self, args: dict[str, str]) -> str:
        """List the indices; or, given one, create, change or (``delete=1``) forget it."""
        if args.get("index"):
            if args.get("delete") in ("1", "true"):
                self.catalog.delete(args["index"])
            else:
                self.catalog.create(args["index"], args.get("path"), **{k: v for k, v in args.items() if k not in ("index", "path", "delete")})
            return json.dumps({"ok": True})
        stats = {r["index"]: r for r in self.catalog.stats().collect()}
        rows = [{"index": r["index"], "path": r["path"], "segments": stats[r["index"]]["segments"], "bytes": stats[r["index"]]["bytes"]} for r in self.catalog.indices().collect()]
        return json.dumps({"indices": rows, "pending": self.pending})

    def metrics(self) -> str:
        return json.dumps({**self.catalog.metrics(), "pending": self.pending, "workers": self.config.workers, "max_pending": self.config.max_pending})


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    config = service.config

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        timeout = config.timeout_s

        def log_message(self, *args) -> None:
            pass

        def body(self) -> bytes:
            """The request's body, of known length or chunked, plain or zstd; never more than max_body, before and after."""
            if sum(len(k) + len(v) for k, v in self.headers.items()) > config.max_header:
                raise Refused(431, "header too large")
            held = bytearray()

            def take(n: int) -> None:
                if len(held) + n > config.max_body:
                    self.close_connection = True
                    raise Refused(413, "body too large")
                held.extend(self.rfile.read(n))

            if "chunked" in self.headers.get("Transfer-Encoding", "").lower():
                while n := int(self.rfile.readline(64).split(b";")[0] or b"0", 16):
                    take(n)
                    self.rfile.readline(8)
                while self.rfile.readline(config.max_header).strip():
                    pass
            else:
                take(int(self.headers.get("Content-Length") or 0))
            if self.headers.get("Content-Encoding", "").lower() != "zstd":
                return bytes(held)
            import zstandard

            plain = zstandard.ZstdDecompressor().stream_reader(bytes(held), read_across_frames=True).read(config.max_body + 1)
            if len(plain) > config.max_body:
                raise Refused(413, "body too large")
            return plain

        def answer(self) -> tuple[int, str]:
            url = urlsplit(self.path)
            args, body = dict(parse_qsl(url.query, keep_blank_values=True)), self.body()
            if url.path == "/health":
                return 200, json.dumps(service.catalog.health())
            if url.path == "/metrics":
                return 200, service.metrics()
            if url.path == "/_bulk" and self.command == "POST":
                return 200, service.bulk(args, body)
            args |= dict(parse_qsl(body.decode("utf-8", "replace"), keep_blank_values=True))  # the body wins
            if url.path in ("/query", "/search"):
                return 200, service.query(args)
            if url.path == "/indices":
                if self.command == "POST" and not args.get("index"):
                    raise Refused(400, "missing index")
                return 200, service.indices(args if self.command == "POST" else {})
            return 404, json.dumps({"error": "not found"})

        def serve(self) -> None:
            try:
                service.enter()
                try:
                    status, text = self.answer()
                finally:
                    service.leave()
            except Refused as e:
                status, text = e.status, json.dumps({"error": str(e)})
            except StoreError as e:
                status, text = 404, json.dumps({"error": str(e)})
            except (QueryError, ValueError) as e:
                status, text = 400, json.dumps({"error": str(e)})
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = serve  # noqa: N815

    return Handler


def start(spark: SparkSession, config: ServerConfig) -> ThreadingHTTPServer:
    """A server that listens (port 0: any free one); run its ``serve_forever``."""
    return ThreadingHTTPServer((config.host, config.port), handler(Service(spark, config)))


def main() -> None:
    path = os.environ.get("SAWMILL_CONFIG")
    text = open(path, encoding="utf-8").read() if path else ""
    spark = SparkSession.builder.appName("sawmill").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    start(spark, ServerConfig.load(text, dict(os.environ))).serve_forever()


if __name__ == "__main__":
    main()
