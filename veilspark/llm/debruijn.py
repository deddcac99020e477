"""The repeated part of a corpus' de Bruijn graph over words, compacted to nonbranching paths.

An edge is a window of ``k`` words, a node one of ``k - 1``; consecutive windows of a document
follow a walk.  Only edges that occur at two places at least are of interest.

1. *Words.*  Texts are cut into words once; a batch of documents is a dictionary (whose words get
   128 bits of their bytes) and codes, zstd-compressed in a table bucketed by batch.
2. *Edges.*  Each batch sends its distinct edges, as 32 bits beside the range they fall into, to
   that range, which answers one bit for each: does another batch have it, too.  This is a filter:
   it may let a window through that occurs once, and never holds one back that repeats.
3. *Nodes.*  Runs of such edges are traces.  Each batch sends each node of its traces once, with the
   word before and after it, none or several; the range groups by node and answers which are
   *stops*: nodes with several neighbours on one side, a trace's end being a neighbour.
4. *Pieces.*  Traces are cut at stops.  From a stop, all walks that begin with the same edge agree up
   to the next one, so equal pieces are equal as a whole: they are rows keyed by 128 bits of
   their words, with both end nodes and their source coordinates (batch, word).  A piece whose
   smallest and largest coordinates differ is repeated; all else goes (step 2's false edges).
5. *Paths.*  Pieces meet by Spark joins at nodes with one piece in and one out; pointer doubling
   gives each its path's first piece and its offset.  A cycle begins at its smallest piece.
6. Batches join their pieces' paths by batch id.

Every message is aggregated by batch first, so an edge, node or piece that is everywhere costs
a row for each batch, and ranges grow in number with the input.  A reducer holds one range.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from veilspark.llm.common import Scratch, fresh_worker, input_bytes, parts_for, trim
from veilspark.llm.kernels import firsts, union_of

BATCH_BYTES, RANGE_BYTES = 6 << 20, 2 << 20
U = np.uint64
NONE, SEVERAL = U(0), U(2)  # identifiers of words are odd
_HEAD = "<4q"


# ---------------------------------------------------------------- step 1: words


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in texts that lie one after another; ``at``: where each begins, and the end."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)  # a text begins or ends here
    edge[at] = True
    before, after = np.r_[False, inside[:-1]] & ~edge[:-1], np.r_[inside[1:], False] & ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    arr = col.cast(pa.large_binary())
    _, off, data = arr.buffers()
    at = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def _packed(text: pa.Array) -> bytes:
    """Words of each text, codes of all words, and the dictionary."""
    at, data = _buffers(text)
    starts, ends = words_of(data, at)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    off = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    letters = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(letters.tobytes())])
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.uint32)
    doff, ddata = _buffers(coded.dictionary)
    n = np.diff(np.searchsorted(starts, at)).astype(np.int64)
    return struct.pack(_HEAD, len(n), len(codes), len(doff) - 1, len(ddata)) + n.tobytes() + doff.tobytes() + codes.tobytes() + ddata.tobytes()


def make_batches(text: str, least: int = BATCH_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of about ``least`` bytes of text, never cut: (batch_id, side: the other columns, body: the words)."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        ctx = TaskContext.get()
        seq, zip_ = (ctx.partitionId() if ctx else 0) << 32, zstandard.ZstdCompressor(level=1)
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            side = t.drop_columns([text])
            with pa.ipc.new_stream(sink, side.schema) as w:
                w.write_table(side)
            body = zip_.compress(_packed(pa.concat_arrays([c.cast(pa.large_string()) for c in t[text].chunks])))
            return pa.RecordBatch.from_pydict({"batch_id": pa.array([seq], pa.int64()), "side": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "body": pa.array([body], pa.binary())})

        for rb in it:
            at, _ = _buffers(rb.column(rb.schema.get_field_index(text)))
            i = 0
            while i < rb.num_rows:
                j = int(np.searchsorted(at, at[i] + least - size, side="left"))
                j = min(max(j, i + 1), rb.num_rows)
                held.append(rb.slice(i, j - i))
                size += int(at[j] - at[i])
                i = j
                if size >= least:
                    yield done()
                    held, size, seq = [], 0, seq + 1
                    trim()
        if held:
            yield done()

    return pack


# ---------------------------------------------------------------- batches


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit name of (x, y); not linear, so that no arrangement of words cancels out."""
    z = x * U(0xD6E8FEB86659FD93)
    z ^= z >> U(32)
    z += y
    z *= U(0x9E3779B97F4A7C15)
    z ^= z >> U(29)
    return z


def names(w: np.ndarray, size: int) -> np.ndarray:
    """Names of every ``size`` words in a row, from names of half of them."""
    h, s = w, 1
    while s * 2 <= size:
        h, s = pair(h[:-s], h[s:]), s * 2
    return pair(h[: len(h) - (size - s)], h[size - s :]) if s < size else h


@dataclass(frozen=True)
class Plan:
    k: int
    bits: int  # 2 ** bits ranges


class Batch:
    """One unpacked batch: ids, words and the walk each document takes through the graph."""

    def __init__(self, side: bytes, body: bytes, plan: Plan):
        self.k, self.bits = plan.k, plan.bits
        self.side = pa.ipc.open_stream(side).read_all().combine_chunks()
        raw = zstandard.ZstdDecompressor().decompress(body)
        docs, n, words, size = struct.unpack_from(_HEAD, raw)
        p = struct.calcsize(_HEAD)
        self.n_words = np.frombuffer(raw, np.int64, docs, p)
        off = np.frombuffer(raw, np.int64, words + 1, p := p + 8 * docs)
        self.codes = np.frombuffer(raw, np.uint32, n, p := p + 8 * (words + 1))
        data = memoryview(raw)[p + 4 * n :]
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), words, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])
        one = xxhash.xxh3_128_digest
        cut = off.tolist()
        self.ids = np.frombuffer(b"".join(one(data[s:e]) for s, e in zip(cut, cut[1:])), np.uint64).reshape(-1, 2)
        self.bounds = np.r_[0, np.cumsum(self.n_words)]
        self.doc = np.repeat(np.arange(docs, dtype=np.int32), self.n_words)

    def walk(self) -> None:
        """Word identifiers, node names, and edges that lie within a document (key 0 elsewhere), all by first word."""
        k = self.k
        self.w = (self.ids[:, 0] | U(1))[self.codes] if len(self.ids) else np.zeros(0, np.uint64)
        if len(self.w) < k:
            self.node, self.edge, self.ok = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool))
            return
        self.node = names(self.w, k - 1)
        self.ok = self.doc[: len(self.w) - k + 1] == self.doc[k - 1 :]
        self.edge = self.key(pair(self.node[:-1], self.node[1:]))

    def key(self, name: np.ndarray) -> np.ndarray:
        """Range and 32 bits of a name."""
        return name >> U(32 - self.bits)

    def ranges(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(range, first, end) of sorted keys."""
        rng = (keys >> U(32)).astype(np.int64)
        cut = np.flatnonzero(firsts(rng)) if len(rng) else np.zeros(0, np.int64)
        yield from zip(rng[cut].tolist(), cut.tolist(), np.r_[cut[1:], len(rng)].tolist())

    def joined(self, keep: np.ndarray, n: np.ndarray) -> pa.Array:
        """For each document its kept words, joined by a space; ``n`` of them stay."""
        flat = self.words.take(pa.array(self.codes[keep]))
        lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int64()), flat)
        return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def _batches(rb: pa.RecordBatch, plan: Plan) -> Iterator[tuple[int, Batch]]:
    for i, side, body in zip(rb["batch_id"].to_pylist(), rb["side"], rb["body"]):
        yield i, Batch(side.as_py(), body.as_py(), plan)


def _rows(kind: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(kind), kind)], schema=kind)


# ---------------------------------------------------------------- steps 2 and 3: edges and nodes

_MESSAGE = pa.schema([("rng", pa.int32()), ("batch_id", pa.int64()), ("blob", pa.binary())])
_MESSAGE_DDL = "rng int, batch_id long, blob binary"
_NODE = np.dtype([("key", "<u4"), ("before", "<u8"), ("after", "<u8")])


def send_edges(plan: Plan):
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for rb in it:
            for i, b in _batches(rb, plan):
                b.walk()
                keys = np.sort(b.edge[b.ok])
                keys = keys[firsts(keys)]
                rows = [(r, i, keys[s:e].astype(np.uint32).tobytes()) for r, s, e in b.ranges(keys)]
                del b, keys
                trim()
                yield from _rows(_MESSAGE, rows).to_batches()

    return send


def _by_range(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[pa.Buffer]]]:
    """Messages of one range at a time; they come sorted by it."""
    now, ids, blobs = None, [], []
    for rb in it:
        for r, i, v in zip(rb["rng"].to_pylist(), rb["batch_id"].to_pylist(), rb["blob"]):
            if r != now and ids:
                yield now, ids, blobs
                ids, blobs = [], []
            now = r
            ids.append(i)
            blobs.append(v.as_buffer())
    if ids:
        yield now, ids, blobs


def _answers(r: int, ids: list[int], sizes: list[int], hit: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows, s = [], 0
    for i, n in zip(ids, sizes):
        if hit[s : s + n].any():
            rows.append((r, i, np.packbits(hit[s : s + n]).tobytes()))
        s += n
    yield from _rows(_MESSAGE, rows).to_batches()


def judge_edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit for each edge sent: another batch has it, too."""
    fresh_worker()
    for r, ids, blobs in _by_range(it):
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs])
        s = np.sort(keys)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            twice = twice[firsts(twice)]
            hit = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
            yield from _answers(r, ids, [len(x) // 4 for x in blobs], hit)
        del keys, s, twice, blobs
        trim()


def judge_nodes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit for each node sent: it is a stop."""
    fresh_worker()
    for r, ids, blobs in _by_range(it):
        rows = np.concatenate([np.frombuffer(x, _NODE) for x in blobs])
        order, cut = _groups(rows["key"])
        branch = _several(rows["before"][order], cut) | _several(rows["after"][order], cut)
        hit = np.empty(len(rows), bool)
        hit[order] = np.repeat(branch, np.diff(np.r_[cut, len(rows)]))
        yield from _answers(r, ids, [len(x) // _NODE.itemsize for x in blobs], hit)
        del rows, order, cut, branch, hit, blobs
        trim()


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return order, np.flatnonzero(firsts(keys[order])) if len(keys) else np.zeros(0, np.int64)


def _several(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether a group has more than one value; a group may say so itself."""
    if not len(x):
        return np.zeros(0, bool)
    low, high = np.minimum.reduceat(x, cut), np.maximum.reduceat(x, cut)
    return (low != high) | (low == SEVERAL)


def _bits(b: Batch, keys: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The answer to each of the sorted keys that were sent."""
    hit = np.zeros(len(keys), bool)
    got = dict(zip(answers["rng"].to_pylist(), answers["blob"]))
    for r, s, e in b.ranges(keys):
        if r in got:
            hit[s:e] = np.unpackbits(np.frombuffer(got[r].as_buffer(), np.uint8), count=e - s).astype(bool)
    return hit


def _traces(b: Batch, answers: pa.Table) -> np.ndarray:
    """Which edges repeat, by first word."""
    keys, at, n = np.unique(b.edge[b.ok], return_inverse=True, return_counts=True)
    rep = np.zeros(len(b.edge), bool)
    rep[b.ok] = ((n > 1) | _bits(b, keys, answers))[at] if len(keys) else False
    return rep


def _trace_nodes(b: Batch, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, key, word before, word after) of all nodes on traces."""
    first = np.r_[rep, False]
    last = np.r_[False, rep]
    at = np.flatnonzero(first | last)
    # An edge covers k words of one document, so the edge before a node belongs to it if it is there at all.
    before = np.where(last[at], b.w[np.maximum(at - 1, 0)], NONE)
    after = np.where(first[at], b.w[np.minimum(at + b.k - 1, len(b.w) - 1)], NONE)
    return at, b.key(b.node[at]), before, after


def send_nodes(plan: Plan):
    """Messages with the nodes of a batch's traces."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_MESSAGE, [])
        i = left["batch_id"][0].as_py()
        b = Batch(left["side"][0].as_py(), left["body"][0].as_py(), plan)
        b.walk()
        rep = _traces(b, right)
        if not rep.any():
            return _rows(_MESSAGE, [])
        _, key, before, after = _trace_nodes(b, rep)
        order, cut = _groups(key)
        keys = key[order][cut]
        rows = np.zeros(len(cut), _NODE)
        rows["key"] = keys.astype(np.uint32)
        for side, x in (("before", before[order]), ("after", after[order])):
            rows[side] = np.where(_several(x, cut), SEVERAL, x[cut])
        out = [(r, i, rows[s:e].tobytes()) for r, s, e in b.ranges(keys)]
        del b
        trim()
        return _rows(_MESSAGE, out)

    return work


# ---------------------------------------------------------------- step 4: pieces

_PIECE = pa.schema([("batch_id", pa.int64()), ("piece", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()),
                    ("starts", pa.list_(pa.int32())), ("id", pa.string()), ("word", pa.int64())])
_PIECE_DDL = "batch_id long, piece binary, a binary, b binary, n long, starts array<int>, id string, word long"


def cut_pieces(plan: Plan, id_col: str):
    """A batch's distinct pieces, from the answers on edges (kind 0) and nodes (1); ``starts`` are all first words of it in the batch."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_PIECE, [])
        bid = left["batch_id"][0].as_py()
        b = Batch(left["side"][0].as_py(), left["body"][0].as_py(), plan)
        b.walk()
        kind = right["kind"].combine_chunks()
        rep = _traces(b, right.filter(pc.equal(kind, 0)))
        if not rep.any():
            return _rows(_PIECE, [])
        at, key, _, _ = _trace_nodes(b, rep)
        order, cut = _groups(key)
        stop = np.zeros(len(b.node) + 1, bool)
        stop[at[order]] = np.repeat(_bits(b, key[order][cut], right.filter(pc.equal(kind, 1))), np.diff(np.r_[cut, len(key)]))
        on = np.flatnonzero(rep)
        begins = stop[on] | np.r_[True, on[1:] != on[:-1] + 1]
        s = on[begins]
        n = np.diff(np.r_[np.flatnonzero(begins), len(on)])
        del b.node, b.edge, rep, stop
        wide, one, k = memoryview(np.ascontiguousarray(b.ids[b.codes])).cast("B"), xxhash.xxh3_128_digest, b.k
        found: dict[bytes, list[int]] = {}
        size: dict[bytes, int] = {}
        for x, m in zip(s.tolist(), n.tolist()):
            d = one(wide[16 * x : 16 * (x + m + k - 1)])
            found.setdefault(d, []).append(x)
            size[d] = m
        ids = b.side.column(id_col).to_pylist()
        doc, first = b.doc, b.bounds
        rows = []
        for d, xs in found.items():
            x, m = xs[0], size[d]
            i = int(doc[x])
            rows.append((bid, d, one(wide[16 * x : 16 * (x + k - 1)]), one(wide[16 * (x + m) : 16 * (x + m + k - 1)]), m, xs, None if ids[i] is None else str(ids[i]), x - int(first[i])))
        del b, wide
        trim()
        return _rows(_PIECE, rows)

    return work


# ---------------------------------------------------------------- step 5: paths


def compact(scratch: Scratch, pieces: DataFrame) -> DataFrame:
    """(piece, path, off) of distinct pieces (piece, a, b, n): a path is named by its first piece.

    ``off`` is the number of edges before the piece on its path.  Nodes with one piece in and
    one out are passed; pointer doubling takes as many rounds as the longest path has doublings.
    """
    ins = pieces.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("c"), F.min("piece").alias("prev"), F.min("n").alias("off")).filter("c = 1")
    outs = pieces.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d"), F.min("piece").alias("piece")).filter("d = 1")
    steps = scratch.table(ins.join(outs, "node").filter("prev <> piece").select("piece", "prev", "off"), "steps")
    n = steps.count()
    heads = pieces.select("piece").join(steps.select("piece"), "piece", "left_anti").select("piece", F.col("piece").alias("path"), F.lit(0).cast("long").alias("off"))
    if not n:
        return heads
    ranked, left = _rank(scratch, steps, n, "path")
    if left is not None:  # cycles: cut each before its smallest piece
        firsts_ = left.select(F.col("least").alias("piece")).distinct()
        rest = steps.join(left.select("piece"), "piece").join(firsts_, "piece", "left_anti")
        again, _ = _rank(scratch, rest, n, "cycle")
        ranked = ranked.union(again).union(firsts_.select("piece", F.col("piece").alias("path"), F.lit(0).cast("long").alias("off")))
    return heads.union(ranked)


def _rank(scratch: Scratch, steps: DataFrame, n: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Pointer doubling: (piece, path, off), and the pieces on cycles with the smallest on theirs."""
    now = steps.select("piece", "prev", "off", F.least("piece", "prev").alias("least"))
    known = now
    for i in range(n.bit_length() + 2):
        up = known.select(F.col("piece").alias("up"), F.col("prev").alias("prev2"), F.col("off").alias("off2"), F.col("least").alias("least2"))
        both = now.join(up, now.prev == up.up, "left")
        moved = both.select("piece", F.coalesce("prev2", "prev").alias("prev"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"),
                            F.least("least", F.coalesce("least2", "least")).alias("least"), F.col("prev2").isNotNull().alias("more"))
        moved = scratch.table(moved, f"{name}-{i}")
        known = now = moved.drop("more")
        if moved.filter("more").isEmpty():
            return moved.select("piece", F.col("prev").alias("path"), "off"), None
    return moved.filter("not more").select("piece", F.col("prev").alias("path"), "off"), moved.filter("more").select("piece", "least")


# ---------------------------------------------------------------- all steps


@dataclass
class Graph:
    """The compacted graph: ``pieces`` (piece, path, off, n, copies, source), and ``spots`` of a batch."""

    batches: DataFrame
    pieces: DataFrame
    spots: DataFrame
    plan: Plan


def build(scratch: Scratch, docs: DataFrame, text: str, id_col: str, k: int) -> Graph:
    """Run the steps up to the paths."""
    if k < 2:
        raise ValueError("a window has two words at least")
    size = input_bytes(docs)
    ranges = parts_for(size, RANGE_BYTES, 16, 1 << 31)
    plan = Plan(k, (ranges - 1).bit_length())
    parts = parts_for(2 * size, 8 << 20, 8, 100_000)  # a task reads ranges one by one
    batches = scratch.bucketed(docs.mapInArrow(make_batches(text), "batch_id long, side binary, body binary"), "batches", "batch_id", parts_for(size, 2 << 20, 8, 50_000))

    def meet(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "rng").sortWithinPartitions("rng")

    def by_batch(rows: DataFrame):
        return batches.groupBy("batch_id").cogroup(rows.groupBy("batch_id"))

    edges = scratch.table(meet(batches.mapInArrow(send_edges(plan), _MESSAGE_DDL)).mapInArrow(judge_edges, _MESSAGE_DDL), "edges")
    scratch.free_shuffles()
    stops = scratch.table(meet(by_batch(edges).applyInArrow(send_nodes(plan), _MESSAGE_DDL)).mapInArrow(judge_nodes, _MESSAGE_DDL), "stops")
    scratch.free_shuffles()
    answers = edges.withColumn("kind", F.lit(0)).union(stops.withColumn("kind", F.lit(1)))
    found = scratch.table(by_batch(answers).applyInArrow(cut_pieces(plan, id_col), _PIECE_DDL), "found")
    scratch.drop("edges", "stops")
    first = F.struct("batch_id", F.element_at("starts", 1).alias("start"), "id", "word")
    some = found.groupBy("piece").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("n").alias("n"), F.sum(F.size("starts")).alias("copies"), F.min(first).alias("source"),
                                      F.max(F.struct("batch_id", F.element_at("starts", -1).alias("start"))).alias("last"))
    again = (F.col("source.batch_id") != F.col("last.batch_id")) | (F.col("source.start") != F.col("last.start"))
    some = scratch.table(some.filter(again).drop("last"), "some")
    paths = scratch.table(compact(scratch, some.select("piece", "a", "b", "n")), "paths")
    pieces = some.join(paths, "piece")
    spots = found.select("batch_id", "piece", "n", "starts").join(paths, "piece").select("batch_id", "n", "starts", "path", "off")
    return Graph(batches, pieces, scratch.table(spots, "spots"), plan)


def finish(graph: Graph, make: Callable[[Batch, np.ndarray, np.ndarray, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """``make(batch, lo, hi, spots)`` gives each batch's rows from its covered words (merged intervals)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    plan, kind = graph.plan, to_arrow_schema(schema)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return kind.empty_table()
        b = Batch(left["side"][0].as_py(), left["body"][0].as_py(), plan)
        starts = right["starts"].combine_chunks() if right.num_rows else None
        s = np.asarray(starts.flatten()).astype(np.int64) if right.num_rows else np.zeros(0, np.int64)
        n = np.repeat(np.asarray(right["n"]), np.asarray(starts.value_lengths())) if right.num_rows else s
        lo, hi = union_of(s, s + n + plan.k - 1)
        out = make(b, lo, hi, right).cast(kind)
        del b
        trim()
        return out

    return graph.batches.groupBy("batch_id").cogroup(graph.spots.groupBy("batch_id")).applyInArrow(last, schema)

