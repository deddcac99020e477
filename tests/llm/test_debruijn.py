"""Substring dedup through the compacted graph: results, paths and coordinates against plain Python."""

import random
import re
from collections import Counter

import pytest
from llm_util import rows_of, same
from test_suffix_dedup import brute_words
from pyspark.sql import functions as F

from veilspark.llm import debruijn, substring_dedup

COLS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def thue_morse(n, x, y):
    s = [0]
    while len(s) < n:
        s += [1 - b for b in s]
    return "".join((x, y)[b] for b in s)


def graph_rows():
    """Texts that branch, end inside others, loop, and repeat within themselves."""
    rng = random.Random(11)
    w = [f"w{i}" for i in range(60)]
    rows = [w, w[:40], w[20:], w[:25] + ["x"] + w[25:], w[10:30] + ["y", "z"] + w[10:30], ["la"] * 30, ["a", "b", "c"] * 9, ["b", "c", "a"] * 4]
    rows += [[rng.choice("pqrs") for _ in range(80)] for _ in range(6)]
    rows += [[], ["one"], None]
    return [(i, None if r is None else " ".join(r)) for i, r in enumerate(rows)]


def brute_paths(rows, k):
    """({(first edge, edges) of each path}, sorted edges of each cycle)."""
    seen = Counter(tuple(x[p : p + k]) for _, t in rows for x in [words(t)] for p in range(len(x) - k + 1))
    edges = {e for e, n in seen.items() if n > 1}
    outs, ins = {}, Counter(e[1:] for e in edges)
    for e in edges:
        outs.setdefault(e[:-1], []).append(e)
    passed = {v for v in outs if len(outs[v]) == 1 and ins[v] == 1}
    paths, used = set(), set()
    for e in edges:
        if e[:-1] not in passed:
            n, x = 1, e
            used.add(x)
            while x[1:] in passed:
                x = outs[x[1:]][0]
                used.add(x)
                n += 1
            paths.add((e, n))
    cycles = []
    for e in edges:
        n, x = 0, e
        while x not in used:
            used.add(x)
            x = outs[x[1:]][0]
            n += 1
        if n:
            cycles.append(n)
    return paths, sorted(cycles)


@pytest.mark.parametrize("k", [35, 5, 2])
def test_digests(docs, doc_rows, k):
    same(rows_of(substring_dedup.digests(docs, window=k), *COLS), brute_words(doc_rows, k))


@pytest.mark.parametrize("k", [2, 3, 7])
def test_paths_are_those_of_a_plain_compaction(spark, k):
    rows = graph_rows()
    text = {str(i): words(t) for i, t in rows}
    got = substring_dedup.paths(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window=k).collect()
    first = {r.path: tuple(text[r.source_id][r.source_word : r.source_word + k]) for r in got}
    paths, cycles = brute_paths(rows, k)
    plain = {(first[r.path], r.n_words - k + 1) for r in got}
    assert paths <= plain and len(plain) == len(got)
    assert sorted(n for _, n in plain - paths) == cycles
    assert k != 3 or cycles  # "a b c" goes round


def test_chains_and_cycles_of_many_pieces(spark):
    from veilspark.llm.common import Scratch

    def piece(i, a, b, n=1):
        return (bytes([i]), bytes([100 + a]), bytes([100 + b]), n)

    rows = [piece(i, i, i + 1, i + 1) for i in range(9)] + [piece(20 + i, 20 + i, 20 + (i + 1) % 5) for i in range(5)] + [piece(40, 50, 50), piece(41, 60, 61), piece(42, 60, 62)]
    df = spark.createDataFrame(rows, "piece binary, a binary, b binary, n long")
    got = {bytes(r.piece)[0]: (bytes(r.path)[0], r.off) for r in debruijn.compact(Scratch(spark, "t"), df).collect()}
    assert got == {i: (0, sum(range(1, i + 1))) for i in range(9)} | {20 + i: (20, i) for i in range(5)} | {40: (40, 0), 41: (41, 0), 42: (42, 0)}


def test_words_that_collide_under_polynomial_hashes(spark):
    head = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{head} {thue_morse(2048, 'a', 'b')}"), (2, f"{head} {thue_morse(2048, 'b', 'a')}")]
    got = substring_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_removed for r in got.collect()] == [0, 0]
    x, y = thue_morse(64, "u ", "v "), thue_morse(64, "v ", "u ")
    rows = [(1, x), (2, y), (3, x + "end")]
    same(rows_of(substring_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")), *COLS), brute_words(rows))


def test_texts_that_part_and_meet_again(spark):
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        s = rng.randrange(200)
        rows.append((i, " ".join(w[s : s + rng.randrange(30, 300)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    same(rows_of(substring_dedup.digests(docs), *COLS), brute_words(rows))


def test_spans_have_source_coordinates(docs, doc_rows):
    text = {r[0]: words(r[1]) for r in doc_rows if r[0] not in (None, 9)}
    got = [r for r in substring_dedup.spans(docs).collect() if r.doc_id in text]
    assert got
    for r in got:
        assert r.path_text == " ".join(text[r.doc_id][r.first_word : r.end_word])
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    gone = {r.doc_id: r.n_removed for r in substring_dedup.digests(docs).collect() if r.n_removed and r.doc_id in text}
    assert {k: len(v) for k, v in covered.items()} == gone


def test_other_ids_columns_and_tables(spark, docs, no_docs):
    assert substring_dedup.digests(no_docs).count() == 0
    assert substring_dedup.paths(no_docs).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))).withColumn("id", F.lit(1)).withColumn("batch_id", F.lit(2))
    got = substring_dedup.digests(named)
    assert got.columns == ["doc_id", "n_words", "n_removed", "n_paths", "kept_sha256"]
    assert {r.doc_id for r in got.collect()} >= {"d0", None}


def test_a_very_long_text(spark):
    rng = random.Random(4)
    long = [f"v{rng.randrange(50_000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[1000:1100])), (3, "ab " * 200_000), (4, "x" * 3_000_000)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (300_000, 100), 2: (100, 100), 3: (200_000, 200_000), 4: (1, 0)}


def test_nothing_is_left_in_the_catalog(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    assert substring_dedup.digests(docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before
