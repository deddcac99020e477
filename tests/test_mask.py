"""Masking, mapping tables, restoring, the engine's calls."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from veilspark.config import EngineConfig, TextTooLongError
from veilspark.functions import spans as S
from veilspark.operators import mask as M
from veilspark.operators.detect import detect
from veilspark.plans.engine import Engine
from veilspark.sources import llm_connector

CONFIG = EngineConfig(today=date(2026, 10, 3), max_text_length=60)


def masked(spark, text, spans):
    """Mask one text with given (fragment, type) pairs, in order."""
    at, made = 0, []
    for frag, kind in spans:
        at = text.index(frag, at)
        made.append((at, at + len(frag), frag, kind, "pattern", 1.0))
        at += len(frag)
    df = spark.createDataFrame([(0, text, made)], f"id long, text string, spans {S.SPANS}")
    return M.demask(M.mask(df)).first()


@pytest.mark.parametrize("text,spans,distinct,restored", [
    ("ООО «Ромашка» и Ромашка тут", [("ООО «Ромашка»", "ORG"), ("Ромашка", "ORG")], 1, "ООО «Ромашка» и ООО «Ромашка» тут"),
    ("Иван, ИВАН", [("Иван", "PER"), ("ИВАН", "PER")], 1, "Иван, Иван"),
    ("«Заря» Заря", [("«Заря»", "ORG"), ("Заря", "ORG")], 1, "«Заря» «Заря»"),
    ("Альфа Бета", [("Альфа", "ORG"), ("Бета", "ORG")], 2, "Альфа Бета"),
    ("119021 Москва Ленина 5", [("119021", "LOC"), ("Москва", "LOC"), ("Ленина", "LOC"), ("5", "LOC")], 4, "119021 Москва Ленина 5"),
    ("Ромашка АО рядом", [("Ромашка АО", "ORG")], 1, "Ромашка АО рядом"),
    ("ничего", [], 0, "ничего"),
])
def test_tokens(spark, text, spans, distinct, restored):
    r = masked(spark, text, spans)
    found = re.findall(r"<[A-Z_]+_[0-9A-F]{8}>", r.masked_text)
    assert len(found) == len(spans) and len(set(found)) == distinct == len(r.mapping)
    assert r.restored_text == restored


def test_token_is_stable(spark):
    r = spark.range(1).select(M.token(F.lit("PER"), F.lit("Иван")).alias("t"), M.normalized(F.lit("ORG"), F.lit("ИП  «Ромашка», ЗАО.")).alias("n")).first()
    import hashlib

    assert r.t == f"<PER_{hashlib.sha256('PER:иван'.encode()).hexdigest()[:8].upper()}>"
    assert r.n == "ромашка"


def test_shared_mapping_table(spark):
    df = spark.createDataFrame([("f", 1, "b@c.ru и a@b.ru"), ("f", 0, "A@B.ru"), ("g", 0, "нет")], "doc string, page int, text string")
    found = M.mask(detect(df, config=CONFIG))
    table = M.mapping_table(found, "doc", "page")
    assert {(r.original, r.mentions, r.n_keys, r.ord) for r in table.collect()} == {("A@B.ru", 2, 1, 1), ("b@c.ru", 1, 1, 2)}
    back = {(r.doc, r.page): r.restored_text for r in M.demask_with_table(found, table, "doc").collect()}
    assert back == {("f", 1): "b@c.ru и A@B.ru", ("f", 0): "A@B.ru", ("g", 0): "нет"}


def test_engine_process(spark):
    e = Engine(spark, CONFIG)
    df = spark.createDataFrame([(1, "почта a@b.ru"), (2, "x" * 61), (3, ""), (4, None)], "id long, text string")
    done, long = e.process(df)
    got = {r.id: r for r in done.collect()}
    assert [r.id for r in long.collect()] == [2] and set(got) == {1, 3, 4}
    assert got[1].llm_response == "почта a@b.ru" and "a@b.ru" not in got[1].masked_text

    def broken():
        def send(prompt, system):
            raise ConnectionError("secret")

        return send

    failed = e.process(df, connect=broken)[0].filter("id = 1").first()
    assert (failed.llm_response, failed.success, failed.error) == ("", False, "ConnectionError")
    assert e.process(df, connect=llm_connector.offline)[0].filter("id = 1").first().success is False
    assert e.process_text("тел. +7 916 123-45-67")["stats"]["entities_detected"] == 1
    with pytest.raises(TextTooLongError):
        e.process_text("x" * 61)
    assert e.process_text("a@b.ru", deny=None)["anonymized_text"].startswith("<EMAIL_")


def test_engine_handles_and_files(spark, tmp_path):
    e = Engine(spark, CONFIG)
    (tmp_path / "a.txt").write_text("a@b.ru, a@b.ru", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    counts = e.detect_files(str(tmp_path)).collect()
    assert len(counts) == 1 and counts[0].entity_counts == {"EMAIL": 2}
    rows = e.mask_files(str(tmp_path)).select("path", "masked_text", "mapping", "handle", "created_at", "masked_path")
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    assert kept.first().masked_path.endswith("a_masked.txt")
    texts = kept.select("handle", F.col("masked_text").alias("text")).unionByName(spark.createDataFrame([("nope", "x")], "handle string, text string"))
    answers, left = e.demask(texts, kept)
    got = {r.status: r.restored_text for r in answers.collect()}
    assert got == {"ok": "a@b.ru, a@b.ru", "unknown handle": None}
    assert left.count() == 0 and e.demask(texts, left)[0].filter("status = 'ok'").count() == 0
    late = e.demask(texts, kept, now="2100-01-01 00:00:00")[0].filter("status = 'ok'")
    assert late.count() == 0
    twice = texts.filter("handle <> 'nope'").union(kept.select("handle", F.lit("zz")))
    assert sorted(r.status for r in e.demask(twice, kept)[0].collect()) == ["ok", "unknown handle"]


def test_masked_files_live_as_long_as_their_handles(spark, tmp_path):
    e = Engine(spark, CONFIG)
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / "in" / f"{n}.txt").write_text(f"{n}@b.ru", encoding="utf-8")
    folder = str(tmp_path / "out")
    kept = e.write_masked_files(folder, str(tmp_path / "in"))
    assert spark.read.text(folder).count() == 2 and kept.count() == 2
    one = kept.orderBy("path").limit(1)
    e.close_masked_files(folder, one.select("handle").union(spark.createDataFrame([("nope",)], "handle string")))
    assert [r.value for r in spark.read.text(folder).collect()] == [r.masked_text for r in spark.read.parquet(f"{folder}/_handles").orderBy("path").collect()][1:]


def test_config_from_session(spark):
    spark.conf.set("veilspark.min_confidence", "0.4")
    spark.conf.set("veilspark.deny", '["слово"]')
    try:
        c = EngineConfig.from_spark(spark)
        assert c.min_confidence == 0.4 and c.deny == ("слово",)
    finally:
        spark.conf.unset("veilspark.min_confidence")
        spark.conf.unset("veilspark.deny")
