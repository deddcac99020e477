"""Quality counters, rates, misses, snapshots."""

import pytest

from veilspark.config import IncomparableSnapshotsError
from veilspark.operators import evaluate as E

SCHEMA = "id string, domain string, text string, entities array<struct<start:int,end:int,type:string>>, pred array<struct<start:int,end:int,entity_type:string>>"


def measure(spark, *examples, section="overall"):
    rows = [(str(i), "dom", "", g, p) for i, (g, p) in enumerate(examples)]
    got = E.with_rates(E.counters(spark.createDataFrame(rows, SCHEMA))).filter(f"section = '{section}'")
    return {r.key: r for r in got.collect()}


def test_rates(spark):
    r = measure(spark, ([(10, 20, "NAME")], [(10, 15, "PER")]))["all"]
    assert (r.leak_recall, r.relaxed_recall, r.strict_recall, r.type_accuracy, r.fp_char_rate) == (0.5, 1.0, 0.0, 1.0, 0.0)
    r = measure(spark, ([(10, 20, "PHONE_NUMBER")], [(10, 20, "PHONE")]))["all"]
    assert [r[k] for k in E.RATES] == [1.0] * 6 + [0.0]
    r = measure(spark, ([(10, 20, "EMAIL")], None))["all"]
    assert r.leak_recall == 0.0 and r.strict_precision is None
    assert measure(spark, ([(0, 10, "NAME")], [(0, 6, "PER"), (4, 10, "PER")]))["all"].covered_chars == 10
    r = measure(spark, (None, [(5, 10, "PER")]))["all"]
    assert (r.fp_char_rate, r.clean_examples, r.clean_examples_with_fp, r.fp_spans_on_clean) == (1.0, 1, 1, 1)
    r = measure(spark, ([(10, 19, "CVC")], [(10, 19, "CVC")]), section="by_group")
    assert set(r) == {"unsupported"} and r["unsupported"].strict_hits == 0 and r["unsupported"].type_evaluated == 0


def test_best_span_is_the_first_of_equals(spark):
    r = measure(spark, ([(0, 10, "NAME")], [(0, 5, "LOC"), (5, 10, "PER")]))["all"]
    assert (r.type_evaluated, r.type_correct) == (1, 0)
    r = measure(spark, ([(0, 10, "NAME")], [(0, 4, "LOC"), (4, 10, "PER")]), section="by_type")
    assert r["NAME"].type_correct == 1


def test_misses_and_empty(spark):
    df = spark.createDataFrame([("a", "d", "", [(0, 5, "EMAIL"), (9, 12, "INN")], [(4, 6, "EMAIL")]), ("b", "d", "", None, None)], SCHEMA)
    assert [tuple(r) for r in E.misses(df).collect()] == [("a", "INN", 9, 12)]
    assert E.counters(df.limit(0)).count() == 0


def snapshot(spark, tmp_path, name, pred, **meta):
    df = spark.createDataFrame([("a", "d", "", [(0, 5, "EMAIL")], pred)], SCHEMA)
    s = E.build_snapshot(E.with_rates(E.counters(df)), {"dataset_revision": "r", "dataset_config": "c", "min_confidence": 0.5, "natasha_available": False, "example_count": 1} | meta)
    E.write_snapshot(s, str(tmp_path / name))
    back = E.read_snapshot(str(tmp_path / name))
    assert back == s and (tmp_path / name).read_text().endswith("}\n")
    return back


def test_compare(spark, tmp_path):
    none, hit = snapshot(spark, tmp_path, "a", []), snapshot(spark, tmp_path, "b", [(0, 5, "EMAIL")], min_confidence=0.4)
    extra = snapshot(spark, tmp_path, "c", [(0, 5, "EMAIL"), (7, 9, "INN")])
    rows, warnings = E.compare_snapshots(spark, none, hit)
    assert len(warnings) == 1
    got = {(r.section, r.metric): r for r in rows.filter("key = 'all' or section = 'by_type'").collect()}
    assert got["overall", "leak_recall"].verdict == "better" and got["overall", "leak_recall"].detail_after == "5/5"
    rows, _ = E.compare_snapshots(spark, hit | {"meta": extra["meta"]}, extra)
    got = {(r.section, r.key, r.metric): r for r in rows.collect()}
    assert got["overall", "all", "fp_char_rate"].verdict == "worse" and got["overall", "all", "leak_recall"].verdict == ""
    assert got["by_pred_type", "INN", "strict_precision"].before is None
    assert E.format_rows(rows).count() == rows.count()
    with pytest.raises(IncomparableSnapshotsError):
        E.compare_snapshots(spark, none, none | {"meta": none["meta"] | {"dataset_revision": "x"}})


def test_predict(spark):
    df = spark.createDataFrame([("a", "d", "почта a@b.ru", [(6, 12, "EMAIL")])], "id string, domain string, text string, entities array<struct<start:int,end:int,type:string>>")
    r = E.with_rates(E.counters(E.predict(df))).filter("section = 'overall'").first()
    assert r.strict_recall == 1.0 and r.strict_precision == 1.0
