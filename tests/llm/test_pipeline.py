"""The pipeline's stages against brute force, each on its own input, and the whole run."""

import random

import corpus_pipeline as P
from llm_util import same
from pyspark.sql import functions as F
from test_similar import brute_kept
from test_suffix_dedup import brute_bytes

from veilspark.llm import bpe


def table(spark, tmp_path, doc_rows):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["en", "de"]), s, len(t or "")) for i, t, s in doc_rows if i is not None and i != 9]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages(spark, tmp_path, doc_rows):
    docs = table(spark, tmp_path, doc_rows)
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_dedup", "suffix_array_dedup", "source_mixing", "bpe_encoding"]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        was, now = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns
        if name == "language_id":
            assert set(now) == {i for i, r in was.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "simhash_dedup":
            assert sorted(now) == brute_kept([(i, r.text) for i, r in was.items()])
        elif name == "suffix_array_dedup":
            assert set(now) == set(was)
            for i, n, gone, _, _ in brute_bytes([(i, was[i].text) for i in was]):
                left = len(now[i].text.encode())
                assert n - gone <= left <= n - gone + 4 * gone // 50 and now[i].n_chars == len(now[i].text)
                assert gone or now[i].text == was[i].text
        elif name == "source_mixing":
            same(sorted(map(tuple, out.collect()), key=str), sorted(map(tuple, docs.collect()), key=str))
        else:
            c = bpe.codec(bpe.default_path())
            assert set(now) == set(was) and all(c.decode(r.ids) == r.text and len(r.ids) == r.n_tokens for r in now.values())
        docs = out
    whole = P.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
    again = P.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))


def test_stages_compose_lazily(spark, tmp_path, doc_rows):
    docs = table(spark, tmp_path, doc_rows)
    lazy = docs
    for _, stage in P.STAGES[:3]:
        lazy = stage(spark, lazy, "")
    written = docs
    for k, (_, stage) in enumerate(P.STAGES[:3]):
        stage(spark, written, "").write.parquet(f"{tmp_path}/w{k}")
        written = spark.read.parquet(f"{tmp_path}/w{k}")
    assert sorted(map(str, lazy.collect())) == sorted(map(str, written.collect()))


def test_clashing_columns_and_null_ids(spark, tmp_path, doc_rows):
    docs = table(spark, tmp_path, doc_rows)
    extra = ("row", "id", "h", "hash", "_id", "_hash", "_fp", "_row", "_set", "key", "node", "text_", "batch_id", "n_bytes", "mix_slot_", "copies", "lead")
    wide = docs.withColumns({c: F.lit("x") for c in extra}).withColumn("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")))
    for name, stage in P.STAGES[:4]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns, name
        assert out.select(*extra).distinct().collect() == [tuple("x" for _ in extra)], name
    assert stage(spark, wide.limit(0), "").count() == 0
