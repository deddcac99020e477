"""Language-model connectors: functions from prompts to answers, their errors as columns.

``echo`` answers with the prompt.  ``chat_completions`` and ``messages`` speak the two usual HTTP
protocols; their senders are made once for each partition and keep one connection opener.  A caller
may pass any ``connect``.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veilspark.config import ConnectorError, ConnectorKeyError

Send = Callable[[str, str | None], str]
#: Posts a JSON body: (address, headers, body, seconds) to (status, body of the answer).
Post = Callable[[str, dict[str, str], bytes, float], tuple[int, bytes]]
#: Request defaults, the protocol's version and the status of a refused key.
TEMPERATURE, MAX_TOKENS, TIMEOUT, VERSION, REFUSED = 0.3, 4096, 120.0, "2023-06-01", 401


def http_post() -> Post:
    """A transport over one opener of the standard library."""
    opener = urllib.request.build_opener()

    def post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, bytes]:
        request = urllib.request.Request(url, body, headers, method="POST")
        try:
            with opener.open(request, timeout=timeout) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, b""

    return post


def _sender(url: str, headers: dict[str, str], body: Callable[[str, str | None], dict], pick: Callable[[dict], str], post: Post, timeout: float) -> Send:
    def send(prompt: str, system: str | None) -> str:
        try:
            status, raw = post(url, headers | {"Content-Type": "application/json"}, json.dumps(body(prompt, system)).encode(), timeout)
        except OSError as e:
            raise ConnectorError(f"not reachable: {type(e).__name__}") from e
        if status == REFUSED:
            raise ConnectorKeyError("the key was refused")
        if status >= 300:
            raise ConnectorError(f"status {status}")
        try:
            return pick(json.loads(raw))
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise ConnectorError("malformed answer") from e

    return send


def chat_completions(base_url: str, key: str, model: str, extra: dict | None = None, transport: Callable[[], Post] = http_post, timeout: float = TIMEOUT) -> Callable[[], Send]:
    """A ``connect`` for services with a /chat/completions call; ``extra`` is added to each request."""

    def body(prompt: str, system: str | None) -> dict:
        turns = [{"role": "system", "content": system}] if system else []
        return {"model": model, "messages": [*turns, {"role": "user", "content": prompt}], "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS, **(extra or {})}

    def connect() -> Send:
        if not key:
            raise ConnectorKeyError("no key is set")
        return _sender(base_url.rstrip("/") + "/chat/completions", {"Authorization": f"Bearer {key}"}, body, lambda d: d["choices"][0]["message"]["content"], transport(), timeout)

    return connect


def messages(url: str, key: str, model: str, transport: Callable[[], Post] = http_post, timeout: float = TIMEOUT) -> Callable[[], Send]:
    """A ``connect`` for services with a messages call and a system field."""

    def body(prompt: str, system: str | None) -> dict:
        return {"model": model, "max_tokens": MAX_TOKENS, "messages": [{"role": "user", "content": prompt}]} | ({"system": system} if system else {})

    def connect() -> Send:
        if not key:
            raise ConnectorKeyError("no key is set")
        return _sender(url, {"x-api-key": key, "anthropic-version": VERSION}, body, lambda d: d["content"][0]["text"], transport(), timeout)

    return connect


def echo() -> Send:
    return lambda prompt, system: prompt


def offline() -> Send:
    """Without a key: no answer, no error."""
    return lambda prompt, system: ""


def ask(df: DataFrame, connect: Callable[[], Send], prompt: str = "masked_text", system: str | None = None) -> DataFrame:
    """Adds response, success and error; a failing request leaves an empty response and goes on."""
    kept = [c for c in df.columns if c not in ("response", "success", "error")]
    base = df.select(*kept)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = connect()
        for f in frames:
            answers = []
            for p in f[prompt]:
                try:
                    r = send(p, system)
                    answers.append((r, bool(r), None))
                except Exception as e:  # noqa: BLE001 - whatever a client raises becomes a row's error
                    answers.append(("", False, type(e).__name__))
            yield f.assign(**{k: [a[i] for a in answers] for i, k in enumerate(("response", "success", "error"))})

    from pyspark.sql.types import BooleanType, StringType, StructField, StructType

    schema = StructType([*base.schema, StructField("response", StringType()), StructField("success", BooleanType()), StructField("error", StringType())])
    return base.mapInPandas(work, schema) if connect is not echo else base.withColumns({"response": F.col(prompt), "success": F.lit(True), "error": F.lit(None).cast("string")})
