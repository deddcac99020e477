"""SimHash near-dedup with covering locality-sensitive hashing (Pagh, 2016).

Bit i of a fingerprint gets a nonzero vector phi(i) of radius + 1 bits; table v (also nonzero)
keeps the bits with odd <phi(i), v>.  Any ``radius`` vectors leave some v orthogonal to all of
them, so a pair within the radius agrees on all bits of some table: no pair is missed.

Distinct fingerprints are the nodes.  Buckets of two give their pair at once; larger ones are
compared in blocks and give a spanning forest of their links, never all pairs.  A bucket over
``CAP`` (32 at least) is covered again on the bits not yet fixed (64, 31, 15, 7 of them), which
ends at 128 fingerprints at the latest, so there is no limit on the size of a group.

Contract: A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles of ``n`` words (a
shorter text is one shingle) are hashed with XXH64, seed 42; a bit is 1 if it is set in over half
the hashes.  Null, empty and blank texts have fingerprint zero.  A row with a null id is linked
like others but names no component.  An empty table gives an empty result.  Ids are integers in
``classes``, which gives its own columns only; ``keep_one`` keeps those of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from veilspark.llm.common import Scratch, fresh_worker, parts_for
from veilspark.llm.graph import components
from veilspark.llm.kernels import mix

RADIUS, SHINGLE, CAP = 4, 4, 2048


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned integer."""
    flat = b" ".join(text.lower().split())
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(gaps) < n:
        return xxhash.xxh64_intdigest(flat, seed)
    starts = np.r_[0, gaps[: len(gaps) - n + 2] + 1].tolist()
    ends = np.r_[gaps[n - 1 :], len(flat)].tolist()
    one = xxhash.xxh64_intdigest
    total, counts = len(ends), np.zeros(64, np.int64)
    for i in range(0, total, 1 << 16):
        h = np.array([one(flat[s:e], seed) for s, e in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _with_fingerprints(text: str, keep_text: bool, n: int):
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        ctx = TaskContext.get()
        at = (ctx.partitionId() if ctx else 0) << 33
        for rb in it:
            col = rb.column(rb.schema.get_field_index(text)).cast(pa.large_binary())
            fp = np.array([fingerprint(x.as_buffer().to_pybytes(), n) if x.is_valid else 0 for x in col], np.uint64)
            out = rb if keep_text else rb.drop_columns([text])
            cols = [*out.columns, pa.array(fp.view(np.int64)), pa.array(np.arange(at, at + rb.num_rows))]
            at += rb.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=[*out.schema.names, "_fp", "_row"])

    return work


def masks(bits: int, radius: int) -> list[int]:
    """Bit masks over the set bits of ``bits`` that cover radius ``radius``."""
    top = 2 ** (radius + 1) - 1
    at = [i for i in range(64) if bits >> i & 1]
    return [m for v in range(1, top + 1) if (m := sum(1 << b for j, b in enumerate(at) if bin((j * 11 % top + 1) & v).count("1") & 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cover_again(radius: int):
    """Rows of too large buckets, dealt to buckets that also fix some of the other bits."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for rb in it:
            key, used, fp = (np.asarray(rb[c]).view(np.uint64) for c in ("key", "used", "fp"))
            for u in np.unique(used):
                on = used == u
                for v, m in enumerate(known.setdefault(int(u), masks(~int(u) & (2**64 - 1), radius))):
                    x = fp[on] & np.uint64(m)
                    k = mix(mix(x, v + 1) + key[on], 1)
                    yield pa.RecordBatch.from_pydict({"key": k.view(np.int64), "used": np.full(len(k), u | np.uint64(m)).view(np.int64), "fp": fp[on].view(np.int64)})

    return work


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect all that are connected among ``fps``."""
    left, out = fps, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(front[:256, None] ^ left[None, :]) <= radius
            hit = near.any(axis=0)
            out += zip(front[near.argmax(axis=0)[hit]].tolist(), left[hit].tolist())
            front, left = np.r_[front[256:], left[hit]], left[~hit]
    return out


def _forests(radius: int):
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            edges: list[tuple[int, int]] = []
            for x in rb["fps"]:
                edges += forest(np.asarray(x.values).view(np.uint64), radius)
            a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*edges)) if edges else ([], [])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def links(scratch: Scratch, nodes: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect whatever the radius connects."""
    full = 2**64 - 1
    n = parts_for(nodes.count() * len(masks(full, radius)) * 24, 16 << 20, 8, 1 << 16)
    nodes = nodes.repartition(n, "fp")  # a small table that is about to grow by the number of masks
    first = [F.struct(F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(_signed(m))).alias("key"), F.lit(_signed(m)).alias("used")) for v, m in enumerate(masks(full, radius))]
    rows = nodes.select("fp", F.explode(F.array(*first)).alias("t")).select("t.key", "t.used", "fp")
    found, level = [], 0
    while True:
        size = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
        size = scratch.table(size, f"sizes-{level}")
        found.append(size.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b"))
        many = rows.join(size.filter(f"n > 2 and n <= {cap}").select("key"), "key")
        many = many.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found.append(many.mapInArrow(_forests(radius), "a long, b long"))
        hot = size.filter(f"n > {cap}").select("key")
        if hot.isEmpty():
            break
        level += 1
        again = rows.join(hot, "key").select("key", "used", "fp").mapInArrow(_cover_again(radius), "key long, used long, fp long")
        rows = scratch.table(again, f"cover-{level}")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _labelled(scratch: Scratch, prints: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fp, component id, first row of the component) for each distinct fingerprint."""
    least = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("_row").alias("row"))).alias("first")
    nodes = scratch.table(prints.groupBy(F.col("_fp").alias("fp")).agg(least), "nodes")
    cc = components(scratch, links(scratch, nodes.select("fp"), radius))
    rooted = nodes.join(cc, nodes.fp == cc.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    rooted = scratch.table(rooted, "rooted")
    tops = rooted.groupBy("root").agg(F.min("first").alias("top"))
    return rooted.join(tops, "root").select("fp", F.col("top.id").alias("component_id"), F.col("top.row").alias("top_row"))


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text))
    prints = rows.mapInArrow(_with_fingerprints(text, False, shingle), f"`{id_col}` long, _fp long, _row long")
    prints = scratch.table(prints, "prints")
    labels = _labelled(scratch, prints, id_col, radius)
    return prints.join(labels, prints._fp == labels.fp).select(id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The table with one document of each group: the smallest id (of equal ids, the first row)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["id"], T.StructField("_fp", T.LongType()), T.StructField("_row", T.LongType())])
    whole = scratch.table(rows.mapInArrow(_with_fingerprints("text", False, shingle), schema), "whole")
    labels = _labelled(scratch, whole.select("id", "_fp", "_row"), "id", radius)
    keep = labels.select(F.col("top_row").alias("_row")).distinct()
    return whole.join(keep, "_row", "left_semi").select("row.*")
