"""Near-dedup by shingle similarity: fingerprints and MinHash bands propose, shingle sets decide.

Two texts are linked if the Jaccard similarity of their sets of ``n``-word shingles is ``LEAST`` or more.

1. Each text gets the identifier of its shingle set, the set's SimHash and ``BANDS`` MinHash bands of ``ROWS`` values.
2. Candidates: SimHashes within a radius (covering LSH, as op1) and sets that share a band.  Only their connected
   components are kept, a star for each band, so that a bucket of any size costs its own length.
3. The texts of a component meet in one task and every candidate pair that could add a link is compared in full.
   Links make the components that count.  In a large component all texts are first compared with one, in many
   tasks; only those that are not linked to it meet the others in blocks.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**28 = 1.5e-5, one of 0.85 with 2e-7; all else is
exact up to 64-bit identifiers of shingles and sets.

Contract: words and shingles are those of simhash.py; null texts and texts without words are equal.  Ids may have any type
that sorts.  A row with a null id is linked like others and kept only where its group has no other; of rows with one id
and one text one stays; an empty table gives an empty result.  All columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from veilspark.llm.common import Scratch, fresh_worker, input_bytes, parts_for
from veilspark.llm.graph import components
from veilspark.llm.kernels import mix
from veilspark.llm.simhash import links

LEAST, SHINGLE, RADIUS, BANDS, ROWS = 0.8, 5, 4, 28, 5
#: Sets and shingles of a component that meet in one task; above that, blocks of this size meet in pairs.
MANY, SHINGLES = 1024, 1 << 20
#: Keys of rows (some 50 bytes each) that may be sent to every task.
FEW = 1 << 20
U = np.uint64
_XOR, _MUL = mix(np.arange(BANDS * ROWS, dtype=U), 5)[:, None], mix(np.arange(BANDS * ROWS, dtype=U), 6)[:, None] | U(1)


def shingles(text: bytes, n: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    flat = b" ".join(text.lower().split())
    if not flat:
        return np.zeros(0, U)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    one = xxhash.xxh64_intdigest
    if len(gaps) < n:
        return np.array([one(flat, seed)], U)
    starts, ends = np.r_[0, gaps[: len(gaps) - n + 2] + 1], np.r_[gaps[n - 1 :], len(flat)]
    step = 1 << 16
    return np.unique(np.concatenate([
        np.array([one(flat[s:e], seed) for s, e in zip(starts[i : i + step].tolist(), ends[i : i + step].tolist())], U)
        for i in range(0, len(ends), step)
    ]))


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(s), 1 << 16):
        counts += np.unpackbits(s[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(s), bitorder="little").view(U)[0])


def bands(s: np.ndarray) -> np.ndarray:
    """Identifiers of the bands of a set: each of the next ``ROWS`` minima under hash functions of their own."""
    low = np.full(BANDS * ROWS, 2**64 - 1, U)
    for i in range(0, len(s), 512):
        np.minimum(low, ((s[None, i : i + 512] ^ _XOR) * _MUL).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=U)
    for x in low.reshape(BANDS, ROWS).T:
        key = mix(key ^ x, 7)
    return key


def _texts(rb: pa.RecordBatch, text: str) -> Iterator[bytes]:
    for x in rb.column(rb.schema.get_field_index(text)).cast(pa.large_binary()):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _described(n: int):
    """Adds the set's identifier, SimHash, size and bands to (id, h, text), without the text."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for rb in it:
            sets, fps, size, low = [], [], [], []
            for t in _texts(rb, "text"):
                s = shingles(t, n)
                sets.append(xxhash.xxh64_intdigest(s.tobytes(), 1))
                fps.append(fingerprint(s))
                size.append(len(s))
                low.append(bands(s))
            lists = np.concatenate(low).view(np.int64) if low else np.zeros(0, np.int64)
            new = [
                pa.array(np.array(sets, U).view(np.int64)), pa.array(np.array(fps, U).view(np.int64)), pa.array(size, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(rb.num_rows + 1) * BANDS, pa.int32()), pa.array(lists)),
            ]
            yield pa.RecordBatch.from_arrays([rb["id"], rb["h"], *new], names=["id", "h", "node", "fp", "n", "bands"])

    return work


def similar(nodes: list[int], sets: list[np.ndarray], least: float, radius: int) -> list[tuple[int, int]]:
    """Links of similarity ``least`` or more that connect all candidates that are connected by such links."""
    size = np.array([len(s) for s in sets])
    low, fp = np.stack([bands(s) for s in sets]), np.array([fingerprint(s) for s in sets], U)
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            c = left[np.minimum(size[left], size[x]) >= (least - 1e-9) * np.maximum(size[left], size[x])]
            c = c[(low[c] == low[x]).any(axis=1) | (np.bitwise_count(fp[c] ^ fp[x]) <= radius)]
            hit = []
            for i in c.tolist():
                both = int((sets[x][np.minimum(np.searchsorted(sets[x], sets[i]), size[x] - 1)] == sets[i]).sum()) if size[x] and size[i] else 0
                if both / max(1, size[x] + size[i] - both) >= least:
                    hit.append(i)
                    out.append((nodes[x], nodes[i]))
            front += hit
            left = np.setdiff1d(left, hit, assume_unique=True)
    return out


def near_one(nodes: list[int], sets: list[np.ndarray], lead: np.ndarray, leader: int, least: float) -> list[tuple[int, int]]:
    """Links of similarity ``least`` or more with the set ``lead`` of node ``leader``."""
    out = []
    for node, s in zip(nodes, sets):
        if node != leader and min(len(s), len(lead)) >= (least - 1e-9) * max(len(s), len(lead)):
            both = int((lead[np.minimum(np.searchsorted(lead, s), len(lead) - 1)] == s).sum()) if len(s) and len(lead) else 0
            if both / max(1, len(s) + len(lead) - both) >= least:
                out.append((leader, node))
    return out


def _verified(n: int, least: float, radius: int):
    """Links of each run of rows with one ``key``; rows are sorted by it, a leader before its followers."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        now, leader = None, None
        held: dict[int, np.ndarray] = {}

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (got := similar(list(held), list(held.values()), least, radius)):
                yield links_of(got)

        def links_of(got: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*got)
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for rb in it:
            for key, lead, node, t in zip(*(rb[c].to_pylist() for c in ("key", "lead", "node")), _texts(rb, "text")):
                if key != now:
                    yield from done()
                    now, leader, held = key, None, {}
                s = shingles(t, n)
                if lead == 0:
                    leader = (node, s)
                elif leader is not None:  # compared at once, never gathered
                    if got := near_one([node], [s], leader[1], leader[0], least):
                        yield links_of(got)
                else:
                    held[node] = s
        yield from done()

    return work


class _Rows:
    """A table's rows by (id, hash of the text).  Keys travel to the rows where their number allows it."""

    def __init__(self, docs: DataFrame, text: str, id_col: str):
        t = F.col(text).cast("string")
        key = F.col(id_col).alias("id"), F.xxhash64(F.coalesce(t, F.lit("")), t.isNull()).alias("h")
        self.rows = docs.select(*key, F.coalesce(t, F.lit("")).alias("text"))
        self.whole = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    @staticmethod
    def match(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """Join by (id, h); stored ``keys`` of at most ``FEW`` rows go to every task, others are dealt out with the rows."""
        keys = keys.withColumnsRenamed({"id": "_id", "h": "_h"})
        if keys.count() <= FEW:
            keys = F.broadcast(keys)
        out = rows.join(keys, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")), how)
        return out if how == "left_anti" else out.drop("_id", "_h")

    @classmethod
    def pick(cls, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows whose (id, h) is in ``keys`` (id, h, copies, ...), one for each, with the other columns of ``keys``."""
        once = cls.match(rows, keys.filter("copies = 1"), "inner").drop("copies")
        many = keys.filter("copies > 1")
        if many.isEmpty():
            return once
        return once.unionByName(cls.match(cls.one_each(rows, many), many, "inner").drop("copies"))

    @classmethod
    def one_each(cls, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """One row for each of the keys."""
        some = cls.match(rows, keys.select("id", "h").distinct(), "inner")
        return some.groupBy("id", "h").agg(*(F.first(c).alias(c) for c in rows.columns if c not in ("id", "h")))

    def kept(self, dropped: DataFrame, many: DataFrame) -> DataFrame:
        """All rows but those of dropped keys; of keys that several rows have, one row."""
        if many.isEmpty():
            return self.match(self.whole, dropped.select("id", "h"), "left_anti")
        once = self.match(self.whole, dropped.select("id", "h").union(many.select("id", "h")), "left_anti")
        return once.unionByName(self.one_each(self.whole, many))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE,
             least: float = LEAST, many: int = MANY, most: int = SHINGLES) -> DataFrame:
    """The table with one document of each group: the smallest id (of equal ids, the text with the smallest hash)."""
    scratch = Scratch(docs.sparkSession, "similar")
    at = _Rows(docs, text, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    prints = scratch.table(at.rows.mapInArrow(_described(shingle), f"id {kind}, h long, node long, fp long, n long, bands array<long>"), "prints")
    rows = scratch.table(prints.groupBy("id", "h").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("node", "fp", "n"))), "rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "copies")).alias("first")
    nodes = scratch.table(rows.groupBy("node").agg(first, F.min("fp").alias("fp"), F.min("n").alias("n")), "nodes")

    keys = prints.dropDuplicates(["node"]).select("fp", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).filter("m <> x").select("key", "m")
    near = scratch.table(keys.join(shared, "key").filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct(), "stars")
    scratch.drop("prints")
    scratch.free_shuffles()
    near = near.union(links(scratch, nodes.select("fp").distinct(), radius))
    cc = components(scratch, near, "near")
    placed = nodes.join(cc, nodes.fp == cc.node, "left").select(nodes.node.alias("node"), "first.id", "first.h", "first.copies", "n", F.coalesce("component", "fp").alias("root"))
    groups = placed.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.min("node").alias("leader")).filter("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / many), F.ceil(F.col("s") / most), F.lit(1)).cast("int")
    placed = scratch.table(placed.join(groups.select("root", "leader", blocks.alias("g")), "root"), "placed")
    parts = parts_for(4 * input_bytes(docs), 32 << 20, 16, 100_000)

    def verified(spots: DataFrame, name: str) -> DataFrame:
        """Links among the texts of each key of (node, id, h, copies, key, lead)."""
        texts = at.pick(at.rows, scratch.table(spots, f"{name}-spots")).select("key", "lead", "node", "text")
        out = scratch.table(texts.repartition(parts, "key").sortWithinPartitions("key", "lead").mapInArrow(_verified(shingle, least, radius), "a long, b long"), f"{name}-links")
        scratch.drop(f"{name}-spots")
        scratch.free_shuffles()
        return out

    column = ("node", "id", "h", "copies")
    found = verified(placed.filter("g = 1").select(*column, F.xxhash64("root").alias("key"), F.lit(1).alias("lead")), "small")
    large = placed.filter("g > 1")
    if not large.isEmpty():
        salt = F.pmod(F.xxhash64("node"), "g").cast("int")
        lead = large.filter("node = leader").select(*column, "root", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("at"), F.lit(0).alias("lead"))
        follow = large.filter("node <> leader").select(*column, "root", salt.alias("at"), F.lit(1).alias("lead"))
        star = verified(lead.union(follow).select(*column, F.xxhash64("root", "at").alias("key"), "lead"), "star")
        found = found.union(star)
        rest = large.filter("node <> leader").join(star.select(F.col("b").alias("node")), "node", "left_anti")
        rests = rest.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / many), F.ceil(F.sum("n") / most)).cast("int").alias("gr"))
        if not rest.isEmpty():
            dealt = large.join(rests, "root").withColumn("at", salt).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("gr") - 1)))
            others = rest.join(rests, "root").withColumn("x", F.pmod(F.xxhash64("node"), "gr").cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
            spots = dealt.select(*column, "root", "at", "x").unionByName(others.select(*column, "root", "at", "x"))
            found = found.union(verified(spots.select(*column, F.xxhash64("root", "at", "x").alias("key"), F.lit(1).alias("lead")), "rest"))
    scratch.drop("placed")

    cc = components(scratch, found, "same")
    rooted = nodes.join(cc, nodes.node == cc.node, "left").select("first", F.coalesce("component", nodes.node).alias("root"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("top")).select(F.col("top.id").alias("_id"), F.col("top.h").alias("_h"))
    same = (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id"))
    judged = scratch.table(rows.select("id", "h", "copies").join(keep, same, "left").select("id", "h", "copies", F.col("_h").isNotNull().alias("stays")), "judged")
    dropped = scratch.table(judged.filter("not stays").select("id", "h"), "dropped")
    many = scratch.table(judged.filter("stays and copies > 1").select("id", "h"), "several")
    scratch.drop(*[n for n in scratch.names if n not in ("dropped", "several")])
    return at.kept(dropped, many).select("row.*")
