"""SimHash near-dedup against brute force."""

import re

import numpy as np
import pytest
import xxhash
from llm_util import rows_of, same

from veilspark.llm import simhash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(ids, fps, radius=4):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    for i, r in enumerate(root):
        yield ids[i], f"{fps[i]:016x}", min((d for d, x in zip(ids, root) if x == r and d is not None), default=None)


def test_masks_cover_every_pair_within_radius():
    rng = np.random.default_rng(1)
    m = simhash.masks(2**64 - 1, 4)
    assert len(m) == 31
    for _ in range(3000):
        d = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(d & x == 0 for x in m)


def test_classes(docs, doc_rows):
    fps = [brute_print(r[1]) for r in doc_rows]
    same(rows_of(simhash.classes(docs), "doc_id", "fingerprint", "component_id"), brute_classes([r[0] for r in doc_rows], fps))


@pytest.mark.parametrize("cap", [32, 40, 2048])
def test_links_at_every_cap(spark, cap):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 9), replace=False)) for b in base for _ in range(150)})
    from veilspark.llm.common import Scratch
    from veilspark.llm.graph import components

    s = Scratch(spark, "t")
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = dict((r.node, r.component) for r in components(s, simhash.links(s, nodes, 4, cap)).collect())
    for i, (f, _, c) in enumerate(brute_classes(fps, fps)):
        assert got.get(f, f) == c


def test_empty_and_keep_one(docs, no_docs):
    assert simhash.classes(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
    docs = docs.filter("doc_id <> 9")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    n = simhash.classes(docs).select("component_id").distinct().count()
    assert kept.count() == n


def test_no_words_share_fingerprint_zero(spark):
    df = spark.createDataFrame([(4, None), (2, ""), (7, " \n\t"), (1, "abc")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(df).collect()}
    assert got[4] == got[2] == got[7] == ("0" * 16, 2)
    assert got[1][1] == 1
