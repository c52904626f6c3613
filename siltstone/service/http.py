"""The service over HTTP, with the standard library's server."""

from __future__ import annotations

import hmac
import json
import logging
import ssl
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from siltstone import errors as E
from siltstone.service.engine import Answer, Engine, error_envelope
from siltstone.sources.catalog import _IDS

_LOG = logging.getLogger("siltstone.http")


def route(engine: Engine, method: str, path: str, body: Callable[[], object]) -> tuple[int, Answer | str]:
    """Status and answer of a request; raises EngineError. ``body`` parses the request's JSON."""
    parts = [unquote(p) for p in path.strip("/").split("/") if p]
    field = lambda name, *default: _field(body(), name, *default)
    match method, parts:
        case "GET", []:
            return 200, engine.info()
        case "GET", ["_health"]:
            return 200, engine.health()
        case "GET", ["_stats"]:
            return 200, engine.stats()
        case "GET", ["_metrics"]:
            return 200, engine.metrics_text()
        case "GET", ["_collections"]:
            return 200, engine.list_collections()
        case "POST", ["_collections"]:
            return 201, engine.create_collection(field("name"))
        case "GET", [c]:
            return 200, engine.collection_info(c)
        case "DELETE", [c]:
            return 200, engine.drop_collection(c)
        case "POST", [c, "docs"]:
            return 201, engine.insert(c, body())
        case "POST", [c, "docs", "_bulk"]:
            return 201, engine.bulk_insert(c, field("documents"))
        case "POST", [c, "docs", "_delete_by_query"]:
            return 200, engine.delete_by_query(c, field("filter"))
        case "POST", [c, "docs", "_update_by_query"]:
            return 200, engine.update_by_query(c, field("filter"), field("update"))
        case "GET", [c, "docs", i]:
            return 200, engine.get(c, i)
        case "PUT", [c, "docs", i]:
            return 200, engine.replace(c, i, body())
        case "PATCH", [c, "docs", i]:
            return 200, engine.patch(c, i, body())
        case "DELETE", [c, "docs", i]:
            return 200, engine.delete(c, i)
        case "POST", [c, "query"]:
            return 200, engine.query(c, _object(body()))
        case "POST", [c, "aggregate"]:
            return 200, engine.aggregate(c, field("pipeline"))
        case "POST", [c, "distinct"]:
            return 200, engine.distinct(c, field("field"), field("filter", None), field("limit", 1000))
        case "GET", [c, "indexes"]:
            return 200, engine.list_indexes(c)
        case "POST", [c, "indexes"]:
            return 201, engine.create_index(c, field("name"), field("fields", None), field("field", None))
        case "DELETE", [c, "indexes", n]:
            return 200, engine.drop_index(c, n)
        case "GET", [c, "ttl"]:
            return 200, engine.get_ttl(c)
        case "PUT", [c, "ttl"]:
            return 200, engine.set_ttl(c, field("retention_days"), field("field", "_created_at"))
        case "DELETE", [c, "ttl"]:
            return 200, engine.delete_ttl(c)
        case "GET", [c, "storage"]:
            return 200, engine.storage_info(c)
        case "GET", [c, "rollup"]:
            return 200, engine.get_rollup(c)
        case "PUT", [c, "rollup"]:
            return 200, engine.set_rollup(c, field("fields", None))
        case "DELETE", [c, "rollup"]:
            return 200, engine.set_rollup(c, [])
    raise (E.WrongMethod(f"{method} {path}") if _known(parts) else E.NoSuchRoute(path))


def _known(parts: list[str]) -> bool:
    """Whether some method has a resource of this form."""
    match parts:
        case [] | [_] | [_, "docs" | "query" | "aggregate" | "distinct" | "indexes" | "ttl" | "storage" | "rollup"] | [_, "docs" | "indexes", _]:
            return True
    return False


def _object(value: object) -> dict:
    if not isinstance(value, dict):
        raise E.InvalidQuery("Request body must be a JSON object")
    return value


def _field(value: object, name: str, *default: object) -> object:
    value = _object(value)
    if name not in value and not default:
        raise E.InvalidQuery(f"missing field `{name}`")
    return value.get(name, *default)


def allowed(keys: list[str], headers, path: str, metrics_public: bool) -> bool:
    """Whether a request may pass: always without keys and for health, else with one of the keys."""
    if not keys or path == "/_health" or (path == "/_metrics" and metrics_public):
        return True
    bearer = headers.get("Authorization") or ""
    given = bearer[7:] if bearer.startswith("Bearer ") else headers.get("X-API-Key") or ""
    return any([hmac.compare_digest(given.encode(), k.encode()) for k in keys])


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080, keys: list[str] = (), metrics_public: bool = False, tls: ssl.SSLContext | None = None) -> ThreadingHTTPServer:
    """A server ready to run (``serve_forever``)."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _answer(self) -> None:
            began = time.monotonic()
            path, engine.lifetime["requests"] = urlsplit(self.path).path, engine.lifetime["requests"] + 1
            data = self.rfile.read(int(self.headers.get("Content-Length") or 0))

            def body() -> object:
                try:
                    return json.loads(data)
                except ValueError as e:
                    raise E.InvalidQuery(f"Invalid JSON: {e}") from e

            try:
                if not allowed(list(keys), self.headers, path, metrics_public):
                    raise E.Unauthorized("Valid API key required")
                status, said = route(engine, self.command, path, body)
                out = said if isinstance(said, str) else json.dumps(said.envelope(), ensure_ascii=False)
            except E.EngineError as e:
                status, out = e.status, json.dumps(error_envelope(e), ensure_ascii=False)
            except Exception as e:  # noqa: BLE001
                status, out = 500, json.dumps(error_envelope(E.EngineError(str(e)[:500])), ensure_ascii=False)
            sent = out.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json" if out[:1] == "{" else "text/plain; version=0.0.4; charset=utf-8")
            self.send_header("Content-Length", str(len(sent)))
            self.send_header("X-Request-Id", _IDS.next())
            self.end_headers()
            self.wfile.write(sent)
            _LOG.info("%s %s %d %.1f ms", self.command, path, status, (time.monotonic() - began) * 1000)

        do_GET = do_POST = do_PUT = do_PATCH = do_DELETE = _answer  # noqa: N815

        def log_message(self, *_) -> None:
            """Requests are logged when they are answered."""

    server = ThreadingHTTPServer((host, port), Handler)
    if tls:
        server.socket = tls.wrap_socket(server.socket, server_side=True)
    return server
