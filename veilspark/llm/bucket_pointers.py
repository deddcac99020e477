"""Bucket-pointer refinement over a corpus' byte windows, without shuffling its texts.

Which windows of 50 bytes also start in a document with a smaller id?  Windows that share their
leftmost smallest q-gram lie side by side in a *run*; that q-gram is the sampled suffix all of
them are found by, so one row stands for about 18 windows.

1. Documents are packed into batches of a few MB, compressed, in a table bucketed by batch.
2. *Initial buckets.*  A batch sends each q-gram bucket of its runs once, with its smallest id.
   Buckets of one document are finished and drop out.
3. *Refinement of runs.*  What is left is sorted on (bucket, name of the run), the name being made
   of the bucket identifiers at later offsets: 16 bytes name 32, those 50 (the last step overlaps).
   A refined bucket settles all its windows at once, and a bucket with a single one is finished.
4. *Refinement of windows.*  Runs of buckets that still hold several are sent as bytes, once each.
   Their windows are sorted by 16 bytes, then by the bucket identifiers (ranks) that this gave at
   offset 16, then by those at offset 18: each step reads the identifiers of the one before, and
   windows whose bucket has one document drop out between steps.  No hash takes part.
5. Batches join the answers by batch id and mark what is covered.

Skew: a batch sends one row for a bucket or run however many of its documents hold it, and one
marker for a bucket with more than ``HOT`` runs in it.  Marked buckets, and those with more than four
times ``HOT`` runs in all, are spread before they meet: their windows go one by one to the range of
the window's own name (128 bits).  Ranges grow in number with the input and are read one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from veilspark.llm import kernels as K
from veilspark.llm.common import Scratch, fresh_worker, input_bytes, parts_for, trim

BATCH_BYTES, RANGE_BYTES, CHUNK_BYTES = 4 << 20, 4 << 20, 1 << 18
HOT = 256
NO_ID = np.iinfo(np.int64).max
U = np.uint64
COVERED, SEND, WIDE = 1, 2, 4


@dataclass(frozen=True)
class Plan:
    """Bytes of a window and of the initial buckets, 2 ** bits ranges."""

    window: int
    q: int
    bits: int = 10
    hot: int = HOT


# ---------------------------------------------------------------- batches


def _text_parts(col: pa.Array) -> tuple[np.ndarray, memoryview]:
    arr = col.cast(pa.large_string())
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return off, memoryview(bufs[2]) if bufs[2] is not None else memoryview(b"")


def make_batches(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        ctx = TaskContext.get()
        seq, zip_ = (ctx.partitionId() if ctx else 0) << 32, zstandard.ZstdCompressor(level=1)
        for rb in it:
            off, data = _text_parts(rb.column(rb.schema.get_field_index(text)))
            i, n = 0, rb.num_rows
            rest = rb.drop_columns([text])
            while i < n:
                j = int(np.searchsorted(off, off[i] + BATCH_BYTES, side="right")) - 1
                j = min(n, max(j, i + 1))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(rest.slice(i, j - i))
                lens = np.diff(off[i : j + 1]).astype(np.int64)
                body = zip_.compress(lens.tobytes() + bytes(data[off[i] : off[j]]))
                yield pa.RecordBatch.from_pydict(
                    {"batch_id": pa.array([seq], pa.int64()), "side": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "body": pa.array([body], pa.binary())}
                )
                seq += 1
                i = j

    return pack


class Batch:
    """One unpacked batch: its documents' bytes, ids and, once asked for, super-k-mers."""

    def __init__(self, side: bytes, body: bytes, plan: Plan, id_col: str):
        self.plan = plan
        self.side = pa.ipc.open_stream(side).read_all().combine_chunks()
        n = self.side.num_rows
        raw = zstandard.ZstdDecompressor().decompress(body)
        self.lens = np.frombuffer(raw, np.int64, n)
        self.buf = np.frombuffer(raw, np.uint8, offset=8 * n)
        self.at = np.r_[0, np.cumsum(self.lens)]
        ids = self.side.column(id_col)
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        self.ids = np.asarray(ids.cast(pa.int64()).fill_null(NO_ID)) if n else np.zeros(0, np.int64)
    def scan(self) -> None:
        """Runs, and the distinct (bucket, name) of them; a bucket with too many names has one, 0."""
        p = self.plan
        self.doc, self.s1, self.s2, a, r = K.runs(self.buf, self.at, p.window, p.q)
        a = K.mix(a, 3) >> U(32 - p.bits)  # smallest hashes are small: spread them; the range and 32 bits are what is sent
        r = r | U(1)
        d = self.ids[self.doc]
        o = K.by_key(a, r, d)
        a, r, d = a[o], r[o], d[o]
        f = K.firsts(a, r)
        fa = K.firsts(a)
        kinds = np.add.reduceat(f.astype(np.int64), np.flatnonzero(fa)) if len(a) else np.zeros(0, np.int64)
        hot = (kinds > p.hot)[np.cumsum(fa) - 1] if len(a) else np.zeros(0, bool)
        f = np.where(hot, fa, f)
        at = np.flatnonzero(f)
        self.key_of = np.empty(len(a), np.int64)  # run -> its key
        self.key_of[o] = np.cumsum(f) - 1
        self.ka, self.kr = a[at], np.where(hot[at], U(0), r[at])
        self.kd = np.minimum.reduceat(d, at) if len(at) else d[:0]
        self.ktop = np.maximum.reduceat(d, at) if len(at) else d[:0]

    def forget(self) -> None:
        """Drop what ``scan`` has found."""
        del self.doc, self.s1, self.s2, self.key_of, self.ka, self.kr, self.kd, self.ktop

    def buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, first key, smallest id, whether it has other ids) of each bucket, sorted."""
        cut = np.flatnonzero(K.firsts(self.ka)) if len(self.ka) else np.zeros(0, np.int64)
        low = np.minimum.reduceat(self.kd, cut) if len(cut) else self.kd
        top = np.maximum.reduceat(self.ktop, cut) if len(cut) else self.kd
        return self.ka[cut], cut, low, low < top


# ---------------------------------------------------------------- steps 2 and 3: buckets and runs

_MESSAGE = pa.schema([("batch_id", pa.int64()), ("rng", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_MESSAGE_DDL = "batch_id long, rng int, kind int, blob binary"
_HEAD, _COLUMN = "<II", "<Bq"
_CODE = np.dtype([("i", "<u4"), ("c", "u1")])


def _ints(x: np.ndarray) -> tuple[int, int, bytes]:
    """(bits of a number, base, the numbers less the base): as narrow as they fit, since shuffles do not compress them."""
    base = int(x.min()) if len(x) else 0
    bits = (int(x.max()) - base).bit_length() if len(x) else 0
    v = (x.astype(np.int64) - np.int64(base)).view(U)  # wraps around where 63 bits do not hold it
    wide = v.astype("<u4" if bits <= 32 else "<u8").reshape(-1, 1).view(np.uint8)
    return bits, base, np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def _from_ints(v: pa.Buffer, n: int, bits: int, base: int, p: int) -> np.ndarray:
    size = 32 if bits <= 32 else 64
    on = np.zeros((n, size), np.uint8)
    on[:, :bits] = np.unpackbits(np.frombuffer(v, np.uint8, (n * bits + 7) // 8, p), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(on, axis=1, bitorder="little").reshape(-1).view(f"<u{size // 8}").astype(np.int64) + np.int64(base)


def _column(x: np.ndarray) -> bytes:
    bits, base, raw = _ints(x)
    return struct.pack(_COLUMN, bits, base) + raw


def _read(v: pa.Buffer, n: int, p: int) -> tuple[np.ndarray, int]:
    """A column of n numbers, and the place after it."""
    bits, base = struct.unpack_from(_COLUMN, v, p)
    p += struct.calcsize(_COLUMN)
    return _from_ints(v, n, bits, base, p), p + (n * bits + 7) // 8


def _rising(x: np.ndarray) -> bytes:
    """Sorted numbers as their steps."""
    x = x.astype(np.int64)
    return struct.pack("<q", x[0]) + _column(np.diff(x))


def _read_rising(v: pa.Buffer, n: int, p: int) -> tuple[np.ndarray, int]:
    steps, after = _read(v, n - 1, p + 8)
    return np.cumsum(np.r_[struct.unpack_from("<q", v, p)[0], steps]), after


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _MESSAGE)], schema=_MESSAGE)


def send_buckets(plan: Plan, id_col: str):
    """Each bucket of a batch once: 32 bits, the smallest id, and whether there are others."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for rb in it:
            for bid, side, body in zip(rb["batch_id"].to_pylist(), rb["side"], rb["body"]):
                b = Batch(side.as_py(), body.as_py(), plan, id_col)
                b.scan()
                key, _, low, more = b.buckets()
                rows = []
                for s, e, rng in _slices(key):
                    rows.append((bid, rng, 0, struct.pack(_HEAD, e - s, s) + _rising(key[s:e].astype(np.uint32)) + _column(low[s:e]) + np.packbits(more[s:e]).tobytes()))
                del b, key, low, more
                trim()
                yield from _table(rows).to_batches()

    return send


def judge_buckets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits for the buckets sent: other documents have it, too."""
    fresh_worker()
    for _, rows in _by_range(it):
        heads = [struct.unpack_from(_HEAD, v) for _, _, v in rows]
        A, M, D = [], [], []
        for (n, _), (_, _, v) in zip(heads, rows):
            x, p = _read_rising(v, n, struct.calcsize(_HEAD))
            A.append(x.astype(np.uint32))
            x, p = _read(v, n, p)
            D.append(x)
            M.append(np.unpackbits(np.frombuffer(v, np.uint8, (n + 7) // 8, p), count=n))
        a, more, d = (np.concatenate(x) for x in (A, M, D))
        o = np.argsort(a, kind="stable")
        cut = np.flatnonzero(K.firsts(a[o]))
        d = d[o]
        open_ = (np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)) | (np.maximum.reduceat(more[o], cut) > 0)
        hit = np.empty(len(a), bool)
        hit[o] = np.repeat(open_, np.diff(np.r_[cut, len(a)]))
        at, out = 0, []
        for (n, start), (bid, _, _) in zip(heads, rows):
            if hit[at : at + n].any():
                out.append((bid, 0, 0, struct.pack("<II", n, start) + np.packbits(hit[at : at + n]).tobytes()))
            at += n
        yield from _table(out).to_batches()
        del rows, A, M, D, a, more, d, o, cut, open_, hit, out
        trim()


def send_runs(plan: Plan, id_col: str):
    """The refined buckets (bucket, name) of a batch that lie in open buckets."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        bid = left["batch_id"][0].as_py()
        b = Batch(left["side"][0].as_py(), left["body"][0].as_py(), plan, id_col)
        b.scan()
        _, cut, _, _ = b.buckets()
        hit = np.zeros(len(cut), bool)
        for x in right["blob"]:
            v = x.as_buffer()
            n, start = struct.unpack_from("<II", v)
            hit[start : start + n] = np.unpackbits(np.frombuffer(v, np.uint8, offset=8), count=n)
        on = np.flatnonzero(np.repeat(hit, np.diff(np.r_[cut, len(b.ka)])))
        ka, kr, kd = b.ka[on], b.kr[on], b.kd[on]
        rows = []
        for s, e, rng in _slices(ka):
            rows.append((bid, rng, 0, struct.pack("<I", e - s) + _rising(on[s:e]) + _rising(ka[s:e].astype(np.uint32)) + _column(kd[s:e]) + kr[s:e].tobytes()))
        del b
        trim()
        return _table(rows)

    return work


def judge_runs(plan: Plan):
    """Which refined buckets have a smaller id elsewhere, which share their bucket with others."""

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for _, rows in _by_range(it):
            yield from one(rows)
            del rows
            trim()

    def one(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        A, R, D, I, B = [], [], [], [], []
        for bid, _, v in rows:
            (n,) = struct.unpack_from("<I", v)
            i, p = _read_rising(v, n, 4)
            x, p = _read_rising(v, n, p)
            I.append(i.astype(np.uint32))
            A.append(x.astype(np.uint32))
            x, p = _read(v, n, p)
            D.append(x)
            R.append(np.frombuffer(v, np.uint64, n, p))
            B.append(np.full(n, bid, np.int64))
        a, r, d, idx, bid = (np.concatenate(x) for x in (A, R, D, I, B))
        o = K.by_key(a.astype(np.uint64) << U(32) | r >> U(32), r, d, bid)
        a, r, d, idx, bid = a[o], r[o], d[o], idx[o], bid[o]
        f, fa = K.firsts(a, r), K.firsts(a)
        g, ga = np.cumsum(f) - 1, np.cumsum(fa) - 1
        kinds = np.bincount(ga, weights=f).astype(np.int64)[ga]
        hot = (np.bincount(ga, weights=(r == 0))[ga] > 0) | (kinds > 4 * plan.hot)
        code = np.zeros(len(a), np.uint8)
        least = d == d[np.flatnonzero(f)][g]  # in several batches, if ids repeat: each needs the answer
        code[~least] |= COVERED
        code[least & (kinds > 1)] |= SEND
        code[hot] = WIDE
        keep = np.flatnonzero(code)
        keep = keep[np.argsort(bid[keep], kind="stable")]
        yield from _answers(bid[keep], np.rec.fromarrays([idx[keep], code[keep]], dtype=_CODE))

    return judge


def _by_range(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows (batch, kind, blob) of one range at a time; they come sorted by it."""
    now, held = None, []
    for rb in it:
        for rng, bid, kind, v in zip(*(rb[c].to_pylist() for c in ("rng", "batch_id", "kind")), rb["blob"]):
            if rng != now and held:
                yield now, held
                held = []
            now = rng
            held.append((bid, kind, v.as_buffer()))
    if held:
        yield now, held


def _answers(bid: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    cut = np.flatnonzero(K.firsts(bid)) if len(bid) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(bid)]
    yield from _table([(int(bid[s]), 0, 1, rows[s:e].tobytes()) for s, e in zip(cut, ends)]).to_batches()


# ---------------------------------------------------------------- step 4: open contents

_GRAM = np.dtype([("k", "<u4"), ("g", "<u8"), ("h", "<u8"), ("d", "<i8")])


def _windows_of(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    n = s2 - s1 + 1
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(first - s1, n)


@dataclass
class Settled:
    """What a batch knows before windows are compared."""

    lo: np.ndarray  # covered for certain
    hi: np.ndarray
    key: np.ndarray  # runs that wait for an answer on their windows: key and first window
    spot: np.ndarray
    sent: np.ndarray  # one run for each key that waits
    gram_key: np.ndarray  # windows of spread buckets that wait: number of the window's name, place
    gram_spot: np.ndarray
    grams: np.ndarray  # distinct names, sorted


def settle(b: Batch, plan: Plan, answers: list) -> Settled:
    code = np.zeros(len(b.ka), np.uint8)
    for x in answers:
        got = np.frombuffer(x.as_buffer(), _CODE)
        code[got["i"]] |= got["c"]
    code[b.kr == 0] = WIDE
    kc, d = code[b.key_of], b.ids[b.doc]
    wide = (kc & WIDE) > 0
    gone = ~wide & (((kc & COVERED) > 0) | (d > b.kd[b.key_of]))
    lo, hi = K.union_of(b.s1[gone], b.s2[gone] + plan.window)
    waiting = np.flatnonzero(~wide & ((kc & SEND) > 0) & (d == b.kd[b.key_of]))
    k = b.key_of[waiting]
    first = np.zeros(len(b.ka), np.int64) - 1
    first[k[::-1]] = waiting[::-1]
    none = np.zeros(0, np.int64)
    out = Settled(lo, hi, k, b.s1[waiting], first[first >= 0], none, none, np.zeros(0, _GRAM))
    w = np.flatnonzero(wide)
    if len(w):
        at = _windows_of(b.s1[w], b.s2[w])
        dw = np.repeat(d[w], b.s2[w] - b.s1[w] + 1)
        g, h = window_names(b.buf, at, plan)
        o = K.by_key(g, h, dw)
        f = K.firsts(g[o], h[o])
        cut = np.flatnonzero(f)
        key = np.empty(len(o), np.int64)
        key[o] = np.cumsum(f) - 1
        low = dw[o][cut]
        done = dw > low[key]
        l2, h2 = K.union_of(at[done], at[done] + plan.window)
        out.lo, out.hi = K.union_of(np.r_[lo, l2], np.r_[hi, h2])
        out.gram_key, out.gram_spot = key[~done], at[~done]
        out.grams = np.zeros(len(cut), _GRAM)
        out.grams["k"], out.grams["g"], out.grams["h"], out.grams["d"] = np.arange(len(cut)), g[o][cut], h[o][cut], low
    return out


def open_runs(plan: Plan, id_col: str):
    """What has to be looked at window by window: runs as bytes (kind 1), names of windows (kind 2)."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(_spread(left, plan, id_col) if left.num_rows else [])
        return _table(_spread(left, plan, id_col, list(right["blob"])))

    return work


def _spread(left: pa.Table, plan: Plan, id_col: str, answers: list | tuple = ()) -> list[tuple]:
    bid = left["batch_id"][0].as_py()
    b = Batch(left["side"][0].as_py(), left["body"][0].as_py(), plan, id_col)
    b.scan()
    got, rows, zip_ = settle(b, plan, list(answers)), [], zstandard.ZstdCompressor(level=1)
    for s, e, rng in _slices(b.ka[b.key_of[got.sent]]):
        x = got.sent[s:e]
        k = b.key_of[x]
        head = _rising(k) + _rising(b.ka[k].astype(np.uint32)) + _column(b.s2[x] - b.s1[x] + 1) + _column(b.kd[k])
        data = b.buf[_windows_of(b.s1[x], b.s2[x] + plan.window - 1)].tobytes()
        rows.append((bid, rng, 1, struct.pack("<I", len(x)) + head + zip_.compress(data)))
    for s, e, rng in _slices(got.grams["g"] >> U(32 - plan.bits)):
        rows.append((bid, rng, 2, got.grams[s:e].tobytes()))
    del b, got
    trim()
    return rows


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, end, range) of sorted keys."""
    rng = (keys >> U(32)).astype(np.int64)
    cut = np.flatnonzero(K.firsts(rng)) if len(rng) else np.zeros(0, np.int64)
    yield from zip(cut.tolist(), np.r_[cut[1:], len(rng)].tolist(), rng[cut].tolist())


def window_names(buf: np.ndarray, at: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names of the windows that begin at ``at`` (sorted), made by doubling from q-gram names."""
    out = np.empty((2, len(at)), np.uint64)
    i = 0
    while i < len(at):
        lo = int(at[i])
        j = max(i + 1, int(np.searchsorted(at, lo + (1 << 19), side="left")))
        s = buf[lo : int(at[j - 1]) + plan.window]
        for x, sym in enumerate((s, K.mix(s.astype(np.uint64), 77))):
            out[x, i:j] = K.refine(K.gram(K.prefix(sym), plan.q, 21 + x), at[i:j] - lo, plan.q, plan.window)
        i = j
    return out[0], out[1]


def _sorted_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of buckets of equal (a, b), both below 2**32, in sorted order."""
    key = a.astype(np.uint64) << U(32) | b.astype(np.uint64)
    o = np.argsort(key)
    out = np.empty(len(o), np.uint32)
    out[o] = np.cumsum(K.firsts(key[o])) - 1
    return out


def smallest_elsewhere(data: np.ndarray, at: np.ndarray, d: np.ndarray, window: int) -> np.ndarray:
    """Which windows (bytes ``data`` from ``at``) are equal to one with a smaller d.

    Buckets of 8 bytes are refined to 16, 32, ... and ``window`` bytes by sorting on (bucket, bucket
    at a later offset); windows leave as soon as their bucket has a single d.
    """
    hit = np.zeros(len(at), bool)
    x = data.astype(np.uint64)
    for s in (1, 2, 4):
        x = x[:-s] << U(8 * s) | x[s:]
    sizes = [8]
    while sizes[-1] * 2 < window:
        sizes.append(sizes[-1] * 2)
    offsets = [{0, window - sizes[-1]}]  # where windows need the identifiers of each size, from the last
    for s in sizes[-2::-1]:
        offsets.append({o + z for o in offsets[-1] for z in (0, s)})
    live = np.arange(len(at))
    rank = np.zeros(len(data) + 1, np.uint32)
    for s, offs in zip(sizes, reversed(offsets)):
        here = np.zeros(len(data) + 1, bool)
        for o in offs:
            here[at[live] + o] = True
        p = np.flatnonzero(here)
        if s == 8:
            o = np.argsort(x[p])
            ids = np.empty(len(p), np.uint32)
            ids[o] = np.cumsum(K.firsts(x[p][o])) - 1 if len(p) else 0
            del x, o
        else:
            ids = _sorted_ids(rank[p], rank[p + s // 2])
        rank = np.zeros(len(data) + 1, np.uint32)
        rank[p] = ids
        live = live[_shared(rank[at[live]], d[live])[0]]
        if not len(live):
            return hit
    ids = _sorted_ids(rank[at[live]], rank[at[live] + window - sizes[-1]])
    hit[live] = d[live] > _shared(ids, d[live])[1]
    return hit


def _shared(ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the bucket has more than one d, the smallest d of the bucket) for each row."""
    if not len(ids):
        return np.zeros(0, bool), d
    o = np.argsort(ids, kind="stable")
    cut = np.flatnonzero(K.firsts(ids[o]))
    size = np.diff(np.r_[cut, len(o)])
    low, top = np.minimum.reduceat(d[o], cut), np.maximum.reduceat(d[o], cut)
    several, least = np.empty(len(o), bool), np.empty(len(o), d.dtype)
    several[o], least[o] = np.repeat(low < top, size), np.repeat(low, size)
    return several, least


def judge_windows(plan: Plan):
    """Windows of open runs by refinement of their bytes; those of spread buckets by their names."""

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for _, rows in _by_range(it):
            yield from of_runs([(bid, v) for bid, kind, v in rows if kind == 1])
            yield from of_names([(bid, v) for bid, kind, v in rows if kind == 2])
            del rows
            trim()

    def of_runs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        K_, A, N, D, B, bytes_, unzip = [], [], [], [], [], [], zstandard.ZstdDecompressor()
        for bid, v in rows:
            (n,) = struct.unpack_from("<I", v)
            p = 4
            for out, get in ((K_, _read_rising), (A, _read_rising), (N, _read), (D, _read)):
                x, p = get(v, n, p)
                out.append(x)
            bytes_.append(np.frombuffer(unzip.decompress(memoryview(v)[p:]), np.uint8))
            B.append(np.full(n, bid, np.int64))
        key, a, n, d, bid, data = (np.concatenate(x) for x in (K_, A, N, D, B, bytes_))
        full = n + plan.window - 1
        s1 = np.cumsum(full) - full
        order = np.argsort(a, kind="stable")  # windows of different buckets differ: some buckets at a time
        cut = np.flatnonzero(K.firsts(a[order]))
        size = np.r_[0, np.cumsum(full[order])]
        mask = np.zeros(len(n), np.uint64)
        i = 0
        while i < len(cut):
            j = max(i + 1, int(np.searchsorted(size[cut], size[cut[i]] + CHUNK_BYTES, side="right")) - 1)
            x = order[cut[i] : cut[j] if j < len(cut) else len(order)]
            own = np.cumsum(full[x]) - full[x]
            at, run = _windows_of(own, own + n[x] - 1), np.repeat(np.arange(len(x)), n[x])
            hit = np.flatnonzero(smallest_elsewhere(data[_windows_of(s1[x], s1[x] + full[x] - 1)], at, d[x][run], plan.window))
            np.bitwise_or.at(mask, x[run[hit]], U(1) << (at[hit] - own[run[hit]]).astype(np.uint64))
            i = j
        keep = np.flatnonzero(mask)
        keep = keep[np.argsort(bid[keep], kind="stable")]
        yield from _answers(bid[keep], np.rec.fromarrays([key[keep], np.full(len(keep), 1), mask[keep]], dtype=_REPLY))

    def of_names(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        recs = [np.frombuffer(v, _GRAM) for _, v in rows]
        rec, bid = np.concatenate(recs), np.repeat(np.array([b for b, _ in rows], np.int64), [len(x) for x in recs])
        o = K.by_key(rec["g"], rec["h"], rec["d"])
        f = K.firsts(rec["g"][o], rec["h"][o])
        d = rec["d"][o]
        keep = o[d > d[np.flatnonzero(f)][np.cumsum(f) - 1]]
        keep = keep[np.argsort(bid[keep], kind="stable")]
        yield from _answers(bid[keep], np.rec.fromarrays([rec["k"][keep], np.full(len(keep), 2), np.ones(len(keep), np.uint64)], dtype=_REPLY))

    return judge


_REPLY = np.dtype([("k", "<u4"), ("kind", "u1"), ("m", "<u8")])


# ---------------------------------------------------------------- step 5: what is covered


def covered(b: Settled, replies: list, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged intervals of a batch's bytes that some removed window covers."""
    got = np.concatenate([np.frombuffer(x.as_buffer(), _REPLY) for x in replies]) if replies else np.zeros(0, _REPLY)
    runs_, grams = got[got["kind"] == 1], got[got["kind"] == 2]
    starts = []
    if len(runs_) and len(b.key):
        o = np.argsort(runs_["k"])
        ks, ms = runs_["k"][o], runs_["m"][o]
        i = np.minimum(np.searchsorted(ks, b.key), len(ks) - 1)
        m = np.where(ks[i] == b.key, ms[i], U(0))
        for bit in range(64):
            on = (m >> U(bit)) & U(1) > 0
            if on.any():
                starts.append(b.spot[on] + bit)
    if len(grams) and len(b.gram_key):
        starts.append(b.gram_spot[np.isin(b.gram_key, grams["k"])])
    s = np.concatenate([b.lo, *starts]) if starts else b.lo
    e = np.concatenate([b.hi, *[x + window for x in starts]]) if starts else b.hi
    return K.union_of(s, e)


def find(scratch: Scratch, docs: DataFrame, window: int, q: int, text: str, id_col: str,
         finish: Callable[[Batch, np.ndarray, np.ndarray], pa.Table], schema: T.StructType, hot: int = HOT) -> DataFrame:
    """Run the five steps; ``finish(batch, lo, hi)`` makes each batch's rows from its covered bytes."""
    if not 16 <= q <= window <= q + 63:
        raise ValueError("q is 16 at least and the window at most 63 bytes longer")
    size = input_bytes(docs)
    ranges = parts_for(size, RANGE_BYTES, 1 << 6, 1 << 31)
    plan = Plan(window, q, (ranges - 1).bit_length(), hot)
    parts = parts_for(2 * size, 4 << 20, 8, 100_000)  # a task reads ranges one by one
    batches = docs.mapInArrow(make_batches(text), "batch_id long, side binary, body binary")
    batches = scratch.bucketed(batches, "batches", "batch_id", parts_for(size, 2 << 20, 8, 50_000))

    def meet(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "rng").sortWithinPartitions("rng")

    def by_batch(rows: DataFrame):
        return batches.groupBy("batch_id").cogroup(rows.groupBy("batch_id"))

    first = scratch.table(meet(batches.mapInArrow(send_buckets(plan, id_col), _MESSAGE_DDL)).mapInArrow(judge_buckets, _MESSAGE_DDL), "buckets")
    scratch.free_shuffles()
    runs = meet(by_batch(first).applyInArrow(send_runs(plan, id_col), _MESSAGE_DDL))
    codes = scratch.table(runs.mapInArrow(judge_runs(plan), _MESSAGE_DDL), "codes")
    scratch.drop("buckets")
    del runs
    scratch.free_shuffles()
    opened = meet(by_batch(codes).applyInArrow(open_runs(plan, id_col), _MESSAGE_DDL))
    replies = scratch.table(opened.mapInArrow(judge_windows(plan), _MESSAGE_DDL), "replies")
    del opened
    scratch.free_shuffles()
    known = codes.withColumn("kind", F.lit(1)).union(replies.withColumn("kind", F.lit(2)))

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return finish_schema.empty_table()
        b = Batch(left["side"][0].as_py(), left["body"][0].as_py(), plan, id_col)
        b.scan()
        answers: dict[int, list] = {1: [], 2: []}
        for k, x in zip(right["kind"].to_pylist(), right["blob"]):
            answers[k].append(x)
        lo, hi = covered(settle(b, plan, answers[1]), answers[2], plan.window)
        b.forget()
        trim()
        return finish(b, lo, hi).cast(finish_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    finish_schema = to_arrow_schema(schema)
    return by_batch(known).applyInArrow(last, schema)
