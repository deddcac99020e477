"""A thin service over the engine: a WSGI application for single texts.

GET /health, POST /v1/anonymize, GET /v1/stats.  Tables are the engine's own way to work; this is for
callers that send one text at a time.  Every request has a mapping of its own.
"""

from __future__ import annotations

import hmac
import json
import logging
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterable

from veilspark.config import EngineError, InvalidConfidenceError, InvalidListEntryError, TextTooLongError
from veilspark.plans.engine import Engine
from veilspark.sources import llm_connector

logger = logging.getLogger(__name__)


class SessionStats:
    """Counts of a running service; types and numbers only, never values."""

    def __init__(self):
        self._lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock:
            self.since, self.ok, self.failed, self.found = time.time(), 0, 0, Counter()

    def add(self, counts: dict[str, int], success: bool) -> None:
        with self._lock:
            self.found.update(counts)
            self.ok, self.failed = self.ok + success, self.failed + (not success)

    def as_dict(self) -> dict:
        with self._lock:
            return {
                "session_duration_seconds": round(time.time() - self.since, 3), "total_requests": self.ok + self.failed, "successful_requests": self.ok,
                "failed_requests": self.failed, "entity_counts": dict(self.found), "total_entities_detected": sum(self.found.values()),
            }


class HttpError(Exception):
    def __init__(self, status: str, detail: str):
        self.status, self.detail = status, detail


class Service:
    """The application; ``api_key`` None accepts every caller and says so once."""

    def __init__(self, engine: Engine, api_key: str | None, connect: Callable = llm_connector.echo):
        self.engine, self.api_key, self.connect, self.stats = engine, api_key, connect, SessionStats()
        if api_key is None:
            logger.warning("the service accepts requests without a key; use this for local work only")

    def __call__(self, environ: dict, start_response: Callable) -> Iterable[bytes]:
        try:
            status, body = "200 OK", self._route(environ)
        except HttpError as e:
            status, body = e.status, {"detail": e.detail}
        raw = json.dumps(body, ensure_ascii=False).encode()
        start_response(status, [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(raw)))])
        return [raw]

    def _route(self, environ: dict) -> dict:
        call = environ["REQUEST_METHOD"], environ.get("PATH_INFO", "")
        if call == ("GET", "/health"):
            return {"status": "ok"}
        if call not in (("GET", "/v1/stats"), ("POST", "/v1/anonymize")):
            raise HttpError("404 Not Found", "no such call")
        given = environ.get("HTTP_X_API_KEY") or ""
        if self.api_key is not None and not (given and hmac.compare_digest(given.encode(), self.api_key.encode())):
            raise HttpError("401 Unauthorized", "missing or invalid API key")
        return self.stats.as_dict() if call[0] == "GET" else self._anonymize(environ)

    def _anonymize(self, environ: dict) -> dict:
        try:
            body = json.loads(environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0)))
            text = body["text"]
            if not isinstance(text, str):
                raise TypeError("text")
        except (ValueError, KeyError, TypeError) as e:
            raise HttpError("422 Unprocessable Entity", "a JSON object with a text is expected") from e
        try:
            out = self.engine.process_text(text, connect=self.connect, system=body.get("system_prompt"), min_confidence=body.get("min_confidence"),
                                           allow=body.get("allow_list"), deny=body.get("deny_list"))
        except (InvalidListEntryError, InvalidConfidenceError, TextTooLongError) as e:
            raise HttpError("422 Unprocessable Entity", str(e)) from e
        except EngineError as e:
            self.stats.add({}, False)
            raise HttpError("502 Bad Gateway", type(e).__name__) from e
        self.stats.add(out["counts"], bool(out["llm_response"]))
        return {k: out[k] for k in ("anonymized_text", "llm_response", "stats")}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8420) -> None:
    """Serve until stopped, one request at a time (the engine's session is shared)."""
    from wsgiref.simple_server import make_server

    with make_server(host, port, service) as server:
        server.serve_forever()
