"""A cache of pinned benchmark files: fetched once, never half written."""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Callable
from pathlib import Path

Fetch = Callable[[str], bytes]


def cache_path(folder: str | Path, revision: str, config: str) -> Path:
    return Path(folder) / revision / f"{config}.parquet"


def fetch_url(url: str, timeout: float = 120.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read()


def ensure_cached(folder: str | Path, revision: str, config: str, known: list[str], url: str, fetch: Fetch = fetch_url) -> Path:
    """The file's path, fetched if it is not there yet.

    ``url`` may hold ``{revision}`` and ``{config}``.  The file gets its name only when it is whole;
    a configuration that is not ``known`` is an error before anything is fetched.
    """
    if config not in known:
        raise ValueError(f"unknown configuration {config!r}, expected one of {known}")
    target = cache_path(folder, revision, config)
    if target.exists():
        return target
    data = fetch(url.format(revision=revision, config=config))
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(f".{os.getpid()}.part")
    try:
        part.write_bytes(data)
        os.replace(part, target)
    finally:
        part.unlink(missing_ok=True)
    return target
