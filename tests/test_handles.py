"""Handles: single use, expiry, in tables and in a stream; audit; SQL functions."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veilspark.operators import audit
from veilspark.operators.detect import detect
from veilspark.plans import udtf
from veilspark.streaming import handles

T0 = datetime(2026, 1, 1)
EVENTS = [("a", 0, "register", "m1"), ("a", 10, "pop", None), ("a", 20, "pop", None), ("b", 0, "pop", None), ("c", 0, "register", "m2"), ("c", 300, "pop", None), ("d", 0, "register", "m3"), ("d", 299, "close", None), ("d", 301, "register", "m4")]
WANT = [("a", "pop", "popped", "m1"), ("a", "pop", "unknown", None), ("a", "register", "registered", None), ("b", "pop", "unknown", None), ("c", "pop", "unknown", None), ("c", "register", "registered", None), ("d", "close", "closed", "m3"), ("d", "register", "registered", None), ("d", "register", "registered", None)]


def table(spark):
    return spark.createDataFrame([(h, T0 + timedelta(seconds=s), op, p) for h, s, op, p in EVENTS], "handle string, ts timestamp, op string, payload string")


def seen(df):
    return sorted(((r.handle, r.op, r.outcome, r.payload) for r in df.collect()), key=str)


def test_table(spark):
    assert seen(handles.resolve(table(spark), 300)) == sorted(WANT, key=str)
    assert handles.resolve(table(spark).drop("payload").limit(0)).count() == 0


def test_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    table(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(table(spark).schema).parquet(str(tmp_path / "in"))
    q = handles.stream(events, 300).writeStream.format("memory").queryName("veil_handles").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:  # timers keep the query busy, so it never reports that all is processed
        until = time.time() + 90
        while spark.table("veil_handles").count() < len(EVENTS) and time.time() < until:
            time.sleep(0.5)
    finally:
        q.stop()
    assert seen(spark.table("veil_handles")) == sorted(WANT, key=str)


def test_sweep(spark):
    df = table(spark).filter("op = 'register'").withColumnRenamed("ts", "created_at")
    now = "2026-01-01 00:05:00"
    assert handles.swept(df, now).count() == 3 and handles.live(df, now).count() == 1


def test_windowed_counts_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(T0 + timedelta(minutes=m), "x") for m in (0, 10, 70, 200)], "ts timestamp, event_type string")
    assert [r.n for r in handles.windowed_counts(df).orderBy("window_start").collect()] == [2, 1, 1]
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = handles.windowed_counts(s).writeStream.format("memory").queryName("veil_counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.n for r in spark.table("veil_counts").collect()) == [1, 2]


def test_audit_has_counts_only(spark):
    df = detect(spark.createDataFrame([("a@b.ru и c@d.ru",), ("нет",)], "text string"))
    e = audit.detection_events(df)
    r = e.first()
    assert e.count() == 1 and r.counts == {"EMAIL": 2} and r.text_length == 15 and "a@b.ru" not in str(r)
    s = audit.session_stats(e).first()
    assert s.total_entities == 2 and s.entity_counts == {"EMAIL": 2} and s.llm_requests == 0
    assert audit.session_stats(e.limit(0)).first().total_entities == 0


def test_sql(spark):
    spark.createDataFrame([(1, "карта 4111 1111 1111 1111, a@b.ru")], "id long, text string").createOrReplaceTempView("veil_texts")
    udtf.detect_view(spark, "veil_texts", "veil_found")
    assert {r.entity_type for r in spark.sql("SELECT entity_type FROM veil_found WHERE confidence > 0.9").collect()} == {"CARD", "EMAIL"}
    udtf.register(spark)
    got = spark.sql("SELECT id, n.valid FROM veil_texts, LATERAL luhn_numbers(text) n").collect()
    assert [tuple(r) for r in got] == [(1, True)]


def test_sources(spark, tmp_path):
    from veilspark.sources import files

    (tmp_path / "a.PDF").write_bytes(b"%PDF" + b"x" * 100)
    ok, big = files.pdf_files(spark, str(tmp_path), limit=50)
    assert (ok.count(), big.count()) == (0, 1)
    df = spark.createDataFrame([("1", "d", "t", None)], files.EXAMPLE_SCHEMA)
    df.write.parquet(str(tmp_path / "ex"))
    assert files.examples(spark, str(tmp_path / "ex")).first().entities == []
    files.write_masked(spark.createDataFrame([("h", "x")], "handle string, masked_text string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).select(F.col("value")).first()[0] == "x"
