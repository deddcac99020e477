"""The thin service, the dataset cache and settings of connectors."""

import io
import json

import pytest

from veilspark.config import ConfigurationError, ConnectorConfig, EngineConfig
from veilspark.operators import evaluate
from veilspark.plans.engine import Engine
from veilspark.service import Service
from veilspark.sources import dataset_cache, llm_connector


def ask(service, method, path, body=None, key=None):
    raw = b"" if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
    env = {"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(raw)), "wsgi.input": io.BytesIO(raw)} | ({"HTTP_X_API_KEY": key} if key else {})
    seen = []
    out = b"".join(service(env, lambda status, headers: seen.append(status)))
    return int(seen[0][:3]), json.loads(out)


def test_service(spark):
    s = Service(Engine(spark, EngineConfig()), "secret")
    assert ask(s, "GET", "/health") == (200, {"status": "ok"})
    assert ask(s, "GET", "/nowhere")[0] == 404
    for key in (None, "wrong"):
        assert ask(s, "POST", "/v1/anonymize", {"text": "x"}, key)[0] == 401 and ask(s, "GET", "/v1/stats", key=key)[0] == 401
    status, body = ask(s, "POST", "/v1/anonymize", {"text": "пишите a@b.ru"}, "secret")
    assert status == 200 and "a@b.ru" not in body["anonymized_text"] and body["llm_response"] == "пишите a@b.ru"
    assert body["stats"]["entities_detected"] == 1
    status, body = ask(s, "POST", "/v1/anonymize", {"text": "пишите a@b.ru", "allow_list": ["a@b.ru"]}, "secret")
    assert body["anonymized_text"] == "пишите a@b.ru"
    for bad in (b"{", {"no": 1}, {"text": 5}, {"text": "x", "min_confidence": 2}, {"text": "x", "deny_list": [""]}, {"text": "x" * 100_001}):
        assert ask(s, "POST", "/v1/anonymize", bad, "secret")[0] == 422
    stats = ask(s, "GET", "/v1/stats", key="secret")[1]
    assert (stats["total_requests"], stats["successful_requests"], stats["entity_counts"], stats["total_entities_detected"]) == (2, 2, {"EMAIL": 1}, 1)
    s.stats.reset()
    assert s.stats.as_dict()["total_requests"] == 0


def test_service_without_key_or_model(spark, caplog):
    s = Service(Engine(spark, EngineConfig()), None, llm_connector.offline)
    assert "without a key" in caplog.text
    assert ask(s, "POST", "/v1/anonymize", {"text": "a"})[1]["llm_response"] == ""
    assert ask(s, "GET", "/v1/stats")[1]["failed_requests"] == 1


def test_dataset_cache(tmp_path):
    calls = []

    def fetch(url):
        calls.append(url)
        if "bad" in url:
            raise OSError("broken")
        return b"data"

    def get(config):
        return dataset_cache.ensure_cached(tmp_path, "r1", config, ["a", "bad"], "https://x/{revision}/{config}", fetch)

    with pytest.raises(ValueError):
        get("other")
    assert get("a").read_bytes() == b"data" and get("a") == tmp_path / "r1" / "a.parquet" and calls == ["https://x/r1/a"]
    with pytest.raises(OSError):
        get("bad")
    assert [p.name for p in (tmp_path / "r1").iterdir()] == ["a.parquet"]


def test_connector_settings(caplog):
    c = ConnectorConfig(chat_key=" k ", chat_url="http://x", model="m")
    assert c.key == "k" and c.has_any_key and "k'" not in repr(c) and c.connect() is not llm_connector.offline
    none = ConnectorConfig(provider="messages")
    assert not none.has_any_key and none.connect() is llm_connector.offline and "no key" in caplog.text
    with pytest.raises(ConfigurationError):
        ConnectorConfig(provider="other")


def test_git_state(tmp_path):
    assert evaluate.git_state(str(tmp_path)) == {"git_commit": None, "git_dirty": None}
