"""Embedding near-dedup with a forest of random-projection trees.

Every node of every tree has a random direction of its own and splits at the median of a bounded
sample's vectors that reach it, down to leaves of about ``LEAF`` vectors of the largest label.
Splits overlap: a vector also goes to the leaf it reaches if its closest split is taken the other
way.  Pairs are compared within leaves of one label, in double precision; a pair is counted in
the first tree whose leaf it shares, so that no list of pairs is shuffled or made distinct.  A leaf
over ``cap`` vectors is cut into blocks, and each pair of blocks is a group of its own.  Links are
unioned by connected components.

Equal vectors are one node with a weight, so a vector that a third of all rows hold is compared
once.  The number of trees is measured, not assumed: sampled vectors get a partner at the
threshold in a random direction, ``TRIALS`` trees show how often both share a leaf, and there
are as many trees as it takes for all but ``MISSED`` of such pairs.  It has no upper bound.

Trees stop where ``THIN`` sampled vectors a node are left; the sample grows with the leaves up to
``SAMPLE_MOST`` vectors, that is ``SAMPLE_MOST / THIN`` leaves and 8 bytes of each to a task and
tree.  Beyond that leaves grow with the input and are compared in blocks.

Contract: vectors are compared only when their labels are equal and not null.  Null, zero or
non-finite vectors and vectors of different lengths link with nothing; rows with a null id are
counted as links of others, and their own component is the smallest id they reach or null; an
empty table gives an empty result.  Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from veilspark.llm.common import Scratch
from veilspark.llm.graph import components
from veilspark.llm.kernels import mix

COSINE, LEAF, CAP, SAMPLE, SAMPLE_MOST, THIN, TRIALS, MISSED = 0.93, 128, 4096, 8192, 1 << 17, 16, 16, 0.001


def depth_of(largest: int, leaf: int = LEAF) -> int:
    """Levels down to leaves of about ``leaf`` vectors, as far as a sample of ``SAMPLE_MOST`` goes."""
    return min(max(0, math.ceil(math.log2(max(1, largest / leaf)))), int(math.log2(SAMPLE_MOST / THIN)))


class Tree:
    """Directions drawn from (tree, node), thresholds at medians of the sample; node n has 2n and 2n + 1."""

    def __init__(self, number: int, depth: int, sample: np.ndarray):
        self.number, self.depth = number, depth
        self.cuts = np.zeros(1 << depth)
        node = np.ones(len(sample), np.int64)
        for _ in range(depth):
            x = self._project(sample, node)
            here, low, high = _medians(node, x)
            self.cuts[here] = (low + high) / 2
            node = node * 2 + (x > self.cuts[node])

    def _project(self, vecs: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Each vector along its node's direction: sums of four uniform numbers a component."""
        here, at = np.unique(node, return_inverse=True)
        seed = mix(here.astype(np.uint64) + (np.uint64(self.number) << np.uint64(40)), 11)
        bits = mix(seed[:, None] + mix(np.arange(vecs.shape[1], dtype=np.uint64), 12)[None, :], 13)
        way = bits.view(np.uint16).reshape(len(here), -1, 4).sum(axis=2, dtype=np.int64) - 2 * 65535.0
        way /= np.sqrt((way * way).sum(axis=1, keepdims=True))
        return np.einsum("ij,ij->i", vecs, way[at])

    def leaves(self, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's leaf, and the leaf beyond its closest split (-1 without splits)."""
        if not self.depth:
            return np.zeros(len(vecs), np.int64), np.full(len(vecs), -1)
        flip, closest = np.zeros(len(vecs), np.int64), np.full(len(vecs), np.inf)
        found = []
        for again in (False, True):
            node = np.ones(len(vecs), np.int64)
            for d in range(self.depth):
                gap = self._project(vecs, node) - self.cuts[node]
                if again:
                    right = (gap > 0) != (flip == d)
                else:
                    right, nearer = gap > 0, np.abs(gap) < closest
                    flip[nearer], closest[nearer] = d, np.abs(gap)[nearer]
                node = node * 2 + right
            found.append(node - (1 << self.depth))
        return found[0], found[1]


def _medians(node: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, both middle values of x in each)."""
    o = np.lexsort((x, node))
    here, start, n = np.unique(node[o], return_index=True, return_counts=True)
    return here, x[o][start + (n - 1) // 2], x[o][start + n // 2]


def trees_for(depth: int, sample: np.ndarray, cosine: float) -> list[Tree]:
    """As many trees as bring all but ``MISSED`` of planted pairs at the threshold into a common leaf."""
    if not depth or len(sample) < 2:
        return [Tree(0, 0, sample)]
    trees = [Tree(t, depth, sample) for t in range(TRIALS)]
    rng = np.random.Generator(np.random.PCG64(5))
    some = sample[rng.permutation(len(sample))[:1000]]
    side = rng.standard_normal(some.shape)
    side -= (side * some).sum(axis=1, keepdims=True) * some
    side /= np.maximum(np.sqrt((side * side).sum(axis=1, keepdims=True)), 1e-12)
    other = cosine * some + math.sqrt(1 - cosine * cosine) * side
    hits = np.zeros(len(some))
    for t in trees:
        (a, b), (c, d) = t.leaves(some), t.leaves(other)
        hits += (a == c) | (a == d) | (b == c) | (b == d)
    lost = 1 - (hits + 0.5) / (TRIALS + 1)
    n = 1
    while (lost**n).mean() > MISSED:
        n += 1
    return trees[:n] + [Tree(t, depth, sample) for t in range(TRIALS, n)]


def _clean(kind: str):
    """Adds the vector's bytes (null if it links with nothing)."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            col = rb["embedding"]
            n = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
            flat = col.flatten()  # without the values of null lists
            x = np.asarray(pc.fill_null(flat, float("nan"))).astype(np.float64)
            at = np.r_[0, np.cumsum(n)]
            bad, full = np.r_[0, np.cumsum(~np.isfinite(x))], np.r_[0, np.cumsum(x != 0)]
            ok = (n > 0) & (np.diff(bad[at]) == 0) & (np.diff(full[at]) > 0) & np.asarray(rb["label"].is_valid())
            raw = memoryview(np.ascontiguousarray(x.astype(kind))).cast("B")
            w = int(kind[2])
            out = [bytes(raw[w * s : w * e]) if k else None for s, e, k in zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([rb["vec_id"], rb["label"], pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    return work


def units(blobs: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _router(trees: list[Tree], dim: int, kind: str, with_vectors: bool):
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            vecs = units(rb["vec"].to_pylist(), dim, kind)
            both = [t.leaves(vecs) for t in trees]
            codes = np.stack([c for pair in both for c in pair], axis=1).astype(_codes(trees[0].depth))
            for t, pair in enumerate(both):
                for leaf in pair:
                    on = np.flatnonzero(leaf >= 0)
                    if not len(on):
                        continue
                    key = (np.int64(t) << np.int64(40)) | leaf[on]
                    cols = [rb["label"].take(pa.array(on)), pa.array(key)]
                    names = ["label", "leaf"]
                    if with_vectors:
                        cols += [rb["node"].take(pa.array(on)), rb["n"].take(pa.array(on)), rb["vec"].take(pa.array(on)), pa.array([c.tobytes() for c in codes[on]], pa.binary())]
                        names += ["node", "n", "vec", "codes"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return work


def _codes(depth: int) -> str:
    return "<i2" if depth < 15 else "<i4"


def _compare(dim: int, kind: str, depth: int, cosine: float):
    """Links of one leaf, or one pair of its blocks: weights linked to each node, a spanning forest."""

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        leaf = t["leaf"][0].as_py()
        tree = leaf >> 40
        a, b = t["a"][0].as_py(), t["b"][0].as_py()
        block = np.asarray(t["block"])
        node, n = np.asarray(t["node"]), np.asarray(t["n"])
        vec = units(t["vec"].to_pylist(), dim, kind)
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), _codes(depth)).reshape(len(node), -1)
        here = leaf & ((1 << 40) - 1)
        row = np.flatnonzero(block == a) if a != b else np.arange(len(node))
        col = np.flatnonzero(block == b) if a != b else row
        linked = np.zeros(len(node), np.int64)
        ea, eb = [], []
        for s in range(0, len(row), 512):
            r = row[s : s + 512]
            near = vec[r] @ vec[col].T >= cosine
            i, j = np.nonzero(near)
            x, y = r[i], col[j]
            ok = node[x] < node[y] if a == b else node[x] != node[y]
            x, y = x[ok], y[ok]
            ok = np.ones(len(x), bool)
            for u in range(tree + 1):  # counted before, in an earlier tree, or in a smaller leaf of this one
                p, q = codes[x, 2 * u : 2 * u + 2], codes[y, 2 * u : 2 * u + 2]
                same = (p[:, :, None] == q[:, None, :]) & (p[:, :, None] >= 0)
                if u == tree:
                    same &= p[:, :, None] < here
                ok &= ~same.any(axis=(1, 2))
            x, y = x[ok], y[ok]
            np.add.at(linked, x, n[y])
            np.add.at(linked, y, n[x])
            keep = _spanning(x, y, len(node))
            ea.append(node[x[keep]])
            eb.append(node[y[keep]])
        on = np.flatnonzero(linked)
        e1, e2 = np.concatenate(ea), np.concatenate(eb)
        first = np.r_[node[on], e1]
        return pa.table({"a": pa.array(first, pa.int64()), "b": pa.array(np.r_[np.zeros(len(on), np.int64), e2], pa.int64()), "n": pa.array(np.r_[linked[on], np.full(len(e1), -1)], pa.int64())})

    return work


def _spanning(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Positions of edges that connect what all edges connect."""
    root = list(range(size))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = []
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        i, j = top(i), top(j)
        if i != j:
            root[i] = j
            keep.append(k)
    return np.array(keep, np.int64)


def _sample(nodes: DataFrame, total: int, size: int, dim: int, kind: str) -> np.ndarray:
    """``size`` vectors by their hashes, expected; twice as many at most."""
    place = F.pmod(F.xxhash64("vec", F.lit(3)), F.lit(total))
    some = nodes.filter(place < size).select("vec").dropDuplicates().limit(2 * size)
    return units(some.toArrow()["vec"].to_pylist(), dim, kind)


def classes(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF, cap: int = CAP, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = scratch.table(rows.mapInArrow(_clean(kind), "vec_id long, label string, vec binary"), "rows")
    nodes = rows.filter("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.octet_length("vec") / int(kind[2])), "nodes")
    partials = None
    for dim in sorted(int(r.dim) for r in nodes.select("dim").distinct().collect()):
        mine = nodes.filter(F.col("dim") == dim).select("label", "vec", "n", "node")
        total, largest = mine.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
        depth = depth_of(largest, leaf)
        base = _sample(mine, total, min(max(sample, 4 * THIN << depth), SAMPLE_MOST), dim, kind) if depth else np.zeros((0, dim))
        trees = trees_for(depth, base, cosine)
        routed = mine.mapInArrow(_router(trees, dim, kind, True), "label string, leaf long, node long, n long, vec binary, codes binary")
        big = mine.mapInArrow(_router(trees, dim, kind, False), "label string, leaf long").groupBy("label", "leaf").count().filter(F.col("count") > cap)
        big = scratch.table(big.select("label", "leaf", F.ceil(F.col("count") / cap).alias("blocks")), f"big-{dim}")
        if not big.isEmpty():
            routed = routed.join(big, ["label", "leaf"], "left")
        else:
            routed = routed.withColumn("blocks", F.lit(None).cast("long"))
        block = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))
        pairs = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
        routed = routed.withColumn("block", block).withColumn("other", pairs)
        routed = routed.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
        got = routed.select("label", "leaf", "a", "b", "block", "node", "n", "vec", "codes").groupBy("label", "leaf", "a", "b").applyInArrow(_compare(dim, kind, depth, cosine), "a long, b long, n long")
        partials = got if partials is None else partials.union(got)
    if partials is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    partials = scratch.table(partials, "links")
    counted = partials.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    cc = components(scratch, partials.filter("n < 0").select("a", "b"))
    joined = nodes.join(counted, "node", "left").join(cc, "node", "left").withColumn("root", F.coalesce("component", "node"))
    joined = scratch.table(joined.select("label", "vec", "root", "least", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")), "joined")
    tops = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = joined.join(tops, "root").select("label", "vec", "n_links", "component_id")
    out = rows.join(labelled, ["label", "vec"], "left")
    component = F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
