"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from veilspark.llm import embed_dedup


def brute(rows):
    unit = []
    for _, v, label in rows:
        x = None if v is None or label is None or not v or any(c is None for c in v) else np.array(v, float)
        ok = x is not None and np.isfinite(x).all() and (x != 0).any()
        unit.append(x / np.linalg.norm(x) if ok else None)
    near = {i: {j for j in range(len(rows)) if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93} for i in range(len(rows))}
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(near[i]), c, r[0] is not None and r[0] == c))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    base = rng.standard_normal((40, 16))
    for i in range(600):
        b = base[rng.integers(40)] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 2.0])
        out.append((i, [float(np.float32(x)) for x in b], int(i % 3)))
    out += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, out[0][1], None), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [float("inf")] + [0.0] * 15, 1), (None, out[3][1], 0), (910, [x * 2 for x in out[3][1]], 0)]
    return out


@pytest.mark.parametrize("leaf,cap", [(10_000, 4096), (10_000, 50), (40, 4096)])
def test_classes(spark, rows, leaf, cap):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(map(tuple, embed_dedup.classes(df, leaf=leaf, cap=cap).collect()), key=str)
    want = sorted(brute(rows), key=str)
    if leaf == 10_000:  # one leaf for each label: exact
        assert got == want
    else:
        assert len(got) == len(want)
        found, there = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.95 * there <= found <= there


def test_empty(spark):
    assert embed_dedup.classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    only = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert list(map(tuple, embed_dedup.classes(only).collect())) == [(1, 0, 1, True)]


def planted_recall(n, dim, leaf, cone, seed=0):
    """(depth, trees, share of planted pairs at 0.93 to 0.95 that share a leaf) of one label."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) + cone
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = x[: n // 2]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.93, 0.95, (len(a), 1))
    y = c * a + np.sqrt(1 - c * c) * side
    depth = embed_dedup.depth_of(n, leaf)
    sample = np.r_[x, y][rng.permutation(n + len(a))[: max(8192, 64 << depth)]]
    trees = embed_dedup.trees_for(depth, sample, 0.93)
    found = np.zeros(len(a), bool)
    for t in trees:
        (p, q), (r, s) = t.leaves(a), t.leaves(y)
        found |= (p == r) | (p == s) | (q == r) | (q == s)
    return depth, len(trees), found.mean()


@pytest.mark.parametrize("n,dim,leaf,cone,depth", [(16_384, 64, 128, 0.0, 7), (16_384, 16, 128, 0.0, 7), (16_384, 64, 128, 2.0, 7), (16_384, 32, 4, 0.0, 12)])
def test_recall_of_deep_trees(n, dim, leaf, cone, depth):
    got = planted_recall(n, dim, leaf, cone)
    print(n, dim, leaf, cone, got)
    assert got[0] == depth and got[2] > 0.99


def test_nodes_have_directions_of_their_own():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 24))
    t = embed_dedup.Tree(3, 5, x)
    a, b = t.leaves(x)
    sizes = np.bincount(a, minlength=32)
    assert sizes.min() >= 4000 // 32 - 1 and sizes.max() <= 4000 // 32 + 1
    assert (a != b).all()
    one = np.ones(len(x), np.int64)
    assert abs(np.corrcoef(t._project(x, 2 * one), t._project(x, 3 * one))[0, 1]) < 0.9


def test_queries_tables_build_trees(spark):
    import os

    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are absent")
    rng = np.random.default_rng(5)
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(path).collect()]
    near = [(10_000 + i, (np.array(v) + rng.standard_normal(len(v)) * np.std(v) * rng.choice([0.2, 0.3, 0.36])).tolist(), label) for i, v, label in rows]
    df = spark.createDataFrame(rows + near, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, embed_dedup.classes(df, leaf=10_000).collect()))
    split = sorted(map(tuple, embed_dedup.classes(df, leaf=8).collect()))
    there, found = sum(r[1] for r in whole), sum(r[1] for r in split)
    assert there > 300 and 0.99 * there <= found <= there
