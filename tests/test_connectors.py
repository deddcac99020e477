"""Connectors without a network: requests, answers and errors; page words by an extractor."""

import json

import pytest

from veilspark.config import ConnectorError, ConnectorKeyError, EngineConfig
from veilspark.plans.engine import Engine
from veilspark.sources import llm_connector as C, page_words


def transport(status=200, answer=None, seen=None, fail=False):
    def make():
        def post(url, headers, body, timeout):
            if fail:
                raise ConnectionRefusedError("no")
            if seen is not None:
                seen.append((url, headers, json.loads(body)))
            return status, b"" if answer is None else json.dumps(answer).encode()

        return post

    return make


def test_chat_completions():
    seen = []
    send = C.chat_completions("http://x/v1/", "k", "m", {"thinking": {"type": "disabled"}}, transport(200, {"choices": [{"message": {"content": "hi"}}]}, seen))()
    assert send("p", "s") == "hi"
    url, headers, body = seen[0]
    assert url == "http://x/v1/chat/completions" and headers["Authorization"] == "Bearer k"
    assert body["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}] and body["thinking"]


def test_messages():
    seen = []
    send = C.messages("http://x/m", "k", "m", transport(200, {"content": [{"text": "yo"}]}, seen))()
    assert send("p", None) == "yo" and "system" not in seen[0][2]
    assert send("p", "s") == "yo" and seen[1][2]["system"] == "s"


@pytest.mark.parametrize("kind", [C.chat_completions, C.messages])
def test_errors(kind):
    def send(**t):
        return kind("http://x", "k", "m", transport=transport(**t))()("p", None)

    with pytest.raises(ConnectorKeyError):
        kind("http://x", "", "m")()
    with pytest.raises(ConnectorKeyError):
        send(status=401)
    for t in ({"status": 500}, {"answer": {"choices": [], "content": []}}, {"answer": None}, {"fail": True}):
        with pytest.raises(ConnectorError):
            send(**t)


def test_process_with_a_service(spark):
    answer = {"choices": [{"message": {"content": "ok"}}]}
    connect = C.chat_completions("http://x", "k", "m", transport=transport(200, answer))
    df = spark.createDataFrame([(1, "a@b.ru")], "id long, text string")
    got = Engine(spark, EngineConfig()).process(df, connect=connect)[0].first()
    assert (got.llm_response, got.success) == ("ok", True)
    bad = Engine(spark, EngineConfig()).process(df, connect=C.messages("http://x", "k", "m", transport(503)))[0].first()
    assert (bad.llm_response, bad.success, bad.error) == ("", False, "ConnectorError")


def test_page_words(spark, tmp_path):
    def lines(content):
        for i, line in enumerate(content.decode().splitlines()):
            for j, w in enumerate(line.split()):
                yield 0, "text", 0, i, j, w, 10.0 * j, 10.0 * i, 10.0 * j + 8, 10.0 * i + 8

    (tmp_path / "a.pdf").write_text("mail a@b.ru\nend")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "c.pdf").write_bytes(b"x" * 50)
    words, failed = page_words.read(spark, str(tmp_path), extractor=lines, limit=40)
    assert sorted((r.doc[-5:], r.error) for r in failed.collect()) == [("b.pdf", "UnicodeDecodeError"), ("c.pdf", "too large")]
    assert words.count() == 3
    boxes, summary = Engine(spark, EngineConfig()).redact_pages(words)
    assert [b.text for b in boxes.collect()] == ["a@b.ru"] and summary.first().redacted_by_type == {"EMAIL": 1}
