"""The pipeline's near-dedup against brute-force similarity of shingle sets."""

import random

import corpus_pipeline as P
import numpy as np
import pytest
from conftest import prose

from veilspark.llm import similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows):
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    return sorted(min(r[0] for r, x in zip(rows, root) if x == k) for k in set(root))


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def rows_near_the_bound():
    rng, rows = random.Random(3), []
    for _ in range(12):
        base = prose(rng, 200)
        rows += [base] + [edited(rng, base, n) for n in (1, 3, 4, 5, 6, 9)]
    rows += [None, "", " \n", "one", "One", "one two", *[prose(rng, 60) for _ in range(10)]]
    return [(i, t) for i, t in enumerate(rows)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def test_stage_links_all_of_similarity_and_nothing_else(spark, doc_rows):
    rows = rows_near_the_bound() + [(1000 + i, r[1]) for i, r in enumerate(doc_rows)]
    fps, sets = [simhash.fingerprint((t or "").encode(), 5) for _, t in rows], [shingle_set(t) for _, t in rows]
    bits = lambda i, j: (fps[i] ^ fps[j]).bit_count()
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    assert any(bits(i, j) > 6 and jaccard(sets[i], sets[j]) >= 0.8 for i, j in pairs)
    assert any(bits(i, j) <= 6 and jaccard(sets[i], sets[j]) < 0.8 for i, j in pairs)
    out = P.simhash_dedup(spark, table(spark, rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in out.collect()) == brute_kept(rows)


@pytest.mark.parametrize("many,most", [(2, 1 << 20), (1024, 300)])
def test_large_components_meet_in_blocks(spark, many, most):
    rows = rows_near_the_bound()
    out = similar.keep_one(table(spark, rows), many=many, most=most)
    assert sorted(r.doc_id for r in out.collect()) == brute_kept(rows)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = prose(rng, 300)
    rows = [(i, edited(rng, base, 5)) for i in range(400)] + [(400, base)]
    assert [r.doc_id for r in similar.keep_one(table(spark, rows), many=64).collect()] == [0]


def test_pairs_at_the_bound_share_a_band():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        x = rng.integers(0, 2**64, 90, dtype=np.uint64)
        a, b = np.unique(x[:85]), np.unique(np.r_[x[:75], x[85:]])  # 75 of 95
        assert (similar.bands(a) == similar.bands(b)).any()


def test_null_and_equal_ids(spark):
    t = prose(random.Random(2), 80)
    df = spark.createDataFrame([(None, t), (7, t + " end"), (7, t), (None, "alone")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in similar.keep_one(df).collect()))) == ["7", "None"]
    assert similar.keep_one(df.limit(0)).count() == 0
