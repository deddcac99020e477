"""Pfair mixing: every prefix is within one block of its target; rows are whole."""

import math
from collections import Counter

from pyspark.sql import functions as F

from veilspark.llm import mixing


def test_period_has_no_missed_deadline(spark):
    unit = spark.createDataFrame([("a", 9, 333), ("b", 9, 1), ("c", 9, 500), ("d", 9, 166)], "key string, rows long, n int")
    got = mixing.period_schedule(unit).collect()
    assert sorted(r.t for r in got) == list(range(1000))
    for r in got:
        assert math.floor(r.i * 1000 / r.n) <= r.t < math.ceil((r.i + 1) * 1000 / r.n)
    done = Counter()
    for r in sorted(got, key=lambda r: r.t):
        done[r.key] += 1
        for k, n in (("a", 333), ("b", 1), ("c", 500), ("d", 166)):
            assert abs(done[k] - (r.t + 1) * n / 1000) < 1


def test_schedule_keeps_every_row(docs):
    out = mixing.schedule(docs, block=4, period=10, group=8)
    assert out.select(*docs.columns).exceptAll(docs).count() == 0 and out.count() == docs.count()
    spots = [(r.mix_slot, r.block_seq) for r in out.collect()]
    assert len(set(spots)) == len(spots)
    assert out.filter("mix_slot < release_slot or mix_slot >= deadline_slot").count() == 0
    blocks = out.groupBy("source", "block_no").agg(F.countDistinct("mix_slot").alias("s"), F.count("*").alias("n")).collect()
    assert all(b.s == 1 and b.n <= 4 for b in blocks)


def test_weights_and_clashing_columns(docs):
    wide = docs.withColumn("mix_slot", F.lit("x")).withColumn("key", F.lit(1))
    out = mixing.schedule(wide, weights={"src0": 3, "src1": 1, None: 1}, block=1, period=10)
    assert out.columns == [*docs.columns, "key", "block_no", "block_seq", "release_slot", "deadline_slot", "mix_slot"]
    first = Counter(r.source for r in out.orderBy("mix_slot").limit(20).collect())
    assert first["src0"] == 12


def test_empty_and_order(docs, no_docs):
    assert mixing.schedule(no_docs).count() == 0
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == docs.count()


def test_more_sources_than_half_a_period(spark):
    rows = [(i, "t", f"s{i % 501}") for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.schedule(docs, block=1)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(1100))
    assert len({r.mix_slot for r in got}) == 1100
    assert all(r.release_slot <= r.mix_slot < r.deadline_slot for r in got)
    assert mixing.mixed(docs).count() == 1100
    many = [(i, "t", f"s{min(i, 40)}") for i in range(300)]
    got = mixing.schedule(spark.createDataFrame(many, "doc_id long, text string, source string"), block=1, period=10).collect()
    assert len(got) == len({r.mix_slot for r in got}) == 300
    assert all(r.release_slot <= r.mix_slot < r.deadline_slot for r in got)


def plain_edf(shares, length):
    """Slots of one period: the released block with the earliest deadline, ties by source."""
    done, out = dict.fromkeys(shares, 0), []
    for t in range(length):
        ready = [(-(-(done[k] + 1) * length // n), k) for k, n in sorted(shares.items()) if done[k] < n and done[k] * length // n <= t]
        k = min(ready)[1]
        done[k] += 1
        out.append(k)
    return out


def test_targets_are_met_over_ten_periods(spark):
    weights = {f"s{i:02}": 0.0005 for i in range(99)} | {"big": 0.9505}
    rows = [(i, "big") for i in range(9505 * 2)] + [(10**6 + i, f"s{i % 99:02}") for i in range(99 * 10)]
    out = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block=1)
    got = sorted((r.mix_slot, r.source) for r in out.collect())
    assert [t for t, _ in got[:19010]] == list(range(19010))
    n, k = 0, Counter()
    for t, s in got[:20000]:
        k[s] += 1
        assert abs(k["big"] - (t + 1) * 0.9505) < 1 and abs(k[s] - (t + 1) * weights[s]) < 1
    assert [s for _, s in got[:2000]] == [s.removeprefix("=") for s in plain_edf({"=" + s: round(w * 2000) for s, w in weights.items()}, 2000)]


def test_odd_names_and_rows_without_ids(spark):
    rows = [(None, s) for s in [None, "\u0001", "", "="] * 50]
    out = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), block=4, group=8)
    assert out.groupBy("source", "block_no").count().filter("count > 4").count() == 0
    assert {r.source: r["count"] for r in out.groupBy("source").count().collect()} == {None: 50, "\u0001": 50, "": 50, "=": 50}
    assert out.select("mix_slot", "block_seq").distinct().count() == 200
