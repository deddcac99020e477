"""Suffix-array dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest


from veilspark.llm import bucket_pointers, suffix_dedup
from llm_util import rows_of, same

BIG = 2**63 - 1


def brute_bytes(rows, w=50):
    key = [BIG if r[0] is None else r[0] for r in rows]
    raw = [(r[1] or "").encode() for r in rows]
    least = {}
    for k, b in zip(key, raw):
        for p in range(len(b) - w + 1):
            g = b[p : p + w]
            least[g] = min(least.get(g, BIG), k)
    for r, k, b in zip(rows, key, raw):
        gone = [False] * len(b)
        for p in range(len(b) - w + 1):
            if least[b[p : p + w]] < k:
                gone[p : p + w] = [True] * w
        kept = bytes(c for c, g in zip(b, gone) if not g)
        n_spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        yield r[0], len(b), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()


def brute_words(rows, w=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(x[p : p + w]) for x in words for p in range(len(x) - w + 1))
    for r, x in zip(rows, words):
        gone = [False] * len(x)
        for p in range(len(x) - w + 1):
            if seen[tuple(x[p : p + w])] > 1:
                gone[p : p + w] = [True] * w
        yield r[0], len(x), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(x, gone) if not g).encode()).hexdigest()


COLS7 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [256, 2, 1])
def test_bytes(docs, doc_rows, hot):
    same(rows_of(suffix_dedup.digests(docs, hot=hot), *COLS7), brute_bytes(doc_rows))


@pytest.mark.parametrize("window", [50, 16, 17, 33, 64])
def test_refinement_of_windows(window):
    import numpy as np

    rng = np.random.default_rng(window)
    data = np.r_[rng.integers(97, 99, 3000), np.tile([97, 98, 97], 300), rng.integers(97, 99, 500)].astype(np.uint8)
    data = np.r_[data, data[500:2500]]
    at = np.sort(rng.choice(len(data) - window, 2000, replace=False))
    d = rng.integers(0, 5, len(at))
    least = {}
    for p, x in zip(at, d):
        w = data[p : p + window].tobytes()
        least[w] = min(least.get(w, 9), x)
    want = [bool(least[data[p : p + window].tobytes()] < x) for p, x in zip(at, d)]
    assert any(want) and bucket_pointers.smallest_elsewhere(data, at, d, window).tolist() == want


def test_a_bucket_in_every_text_is_spread(spark):
    import random

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = "the same line that all of these texts have in common, of 70 bytes."
    rows = [(i, word(40) + line[: 20 + i % 50] + word(40) + line + word(30)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for hot in (256, 3):
        same(rows_of(suffix_dedup.digests(docs, hot=hot), *COLS7), brute_bytes(rows))


def test_empty(no_docs):
    assert suffix_dedup.digests(no_docs).count() == 0
    assert suffix_dedup.remove(no_docs).columns == no_docs.columns


def test_remove_keeps_rows_and_columns(docs):
    out = suffix_dedup.remove(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_clashing_column(docs):
    from pyspark.sql import functions as F

    wide = docs.withColumn("n_bytes", F.lit(7)).withColumn("batch_id", F.lit("x"))
    out = suffix_dedup.remove(wide)
    assert out.columns == wide.columns
    assert out.select("n_bytes", "batch_id").distinct().collect() == [(7, "x")]


def test_long_document_is_cut(spark, monkeypatch):
    from veilspark.llm import kernels
    import numpy as np

    monkeypatch.setattr(kernels, "_GROUP", 1000)
    rng = np.random.default_rng(0)
    a = rng.integers(97, 123, 5000).astype(np.uint8)
    sym, bounds = kernels.BYTE_TABLE[a], np.array([0, 5000])
    doc, s1, s2, _, _ = kernels.runs(sym, bounds, 50, 16)
    starts = np.sort(np.concatenate([np.arange(x, y + 1) for x, y in zip(s1, s2)]))
    assert starts.tolist() == list(range(4951))


@pytest.mark.parametrize("same_id", [None, 9])
def test_equal_rows_of_one_id_in_different_batches(spark, same_id):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for i in range(12):
        p, x, y = word(300), word(200), word(200)
        rows += [(1, word(90) + p + word(90)), (same_id, x + p + y), (same_id, x + p + y)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    same(rows_of(suffix_dedup.digests(docs), *COLS7), brute_bytes(rows))


@pytest.mark.parametrize("span", [0, 1, 255, 256, 65_535, 2**24, 2**32 - 1, 2**32, 2**62, BIG])
def test_numbers_are_sent_in_no_more_bits_than_needed(span):
    for low in (-7, 0, 10**6):
        x = np.array([low, min(low + span, BIG), low, low], np.int64)
        bits, base, raw = bucket_pointers._ints(x)
        assert bits == (int(x.max()) - low).bit_length() and len(raw) == (4 * bits + 7) // 8
        assert bucket_pointers._from_ints(raw, 4, bits, base, 0).tolist() == x.tolist()
        for n in (1, 4):
            raw = b"?" + bucket_pointers._rising(np.sort(x)[:n]) + bucket_pointers._column(x[:0])
            got, p = bucket_pointers._read_rising(raw, n, 1)
            assert got.tolist() == np.sort(x)[:n].tolist() and bucket_pointers._read(raw, 0, p)[1] == len(raw)
