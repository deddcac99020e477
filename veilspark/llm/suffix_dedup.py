"""Suffix-array dedup by bucket-pointer refinement (Schürmann and Stoye, 2005), sampled and distributed.

All suffixes that begin with one q-gram form a bucket; a bucket of one document is finished.
The others are refined by sorting on bucket identifiers of later offsets: two 16-byte buckets
name one of 32 bytes, two of those one of 50 (the last step overlaps), and each step reads the
identifiers of the step before.  Initial buckets are kept at the smallest q-gram of each 50-byte
window only; see :mod:`bucket_pointers` for how they are sorted without shuffling texts.

Contract: byte strings of ``window`` bytes (UTF-8) that also start in a document with a smaller
id are removed, overlaps included, judged on the input.  Ids are integers.  Null texts count as
empty, texts under ``window`` bytes keep everything, a null id counts as larger than every id, rows
of one id never remove each other's bytes, an empty table gives an empty result.  Other columns
are kept by ``remove``, whatever their names.  Equal runs of windows are told by a 32-bit bucket, its
range and a 64-bit name; windows of unequal runs are compared by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from veilspark.llm import bucket_pointers as W
from veilspark.llm.common import Scratch

WINDOW, Q = 50, 16


def _cut(b: W.Batch, lo: np.ndarray, hi: np.ndarray):
    """For each document: its bytes, and the covered intervals clipped to it (relative)."""
    first = np.searchsorted(hi, b.at[:-1], side="right")
    last = np.searchsorted(lo, b.at[1:], side="left")
    for i in range(len(b.lens)):
        s, e = int(b.at[i]), int(b.at[i + 1])
        f, l = (first[i], last[i]) if e > s else (0, 0)
        yield b.buf[s:e], np.maximum(lo[f:l], s) - s, np.minimum(hi[f:l], e) - s


def _kept(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    if not len(lo):
        return data.tobytes()
    raw = memoryview(data)
    return b"".join(raw[a:z] for a, z in zip(np.r_[0, hi].tolist(), np.r_[lo, len(data)].tolist()))


def _whole_chars(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Kept bytes of a text; a character of which any byte stays, stays whole."""
    lo, hi = lo.copy(), hi.copy()
    cont = (data & 0xC0) == 0x80
    for _ in range(3):
        move = (lo < hi) & (lo < len(data)) & cont[np.minimum(lo, len(data) - 1)]
        lo = lo + move
        back = (hi > lo) & (hi < len(data)) & cont[np.minimum(hi, len(data) - 1)]
        hi = hi - back
    return _kept(data, lo, np.maximum(lo, hi))


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, q: int = Q, hot: int = W.HOT) -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs, SHA-256 of what stays."""
    schema = T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def finish(b: W.Batch, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
        n, spans, sha = [], [], []
        for data, s, e in _cut(b, lo, hi):
            n.append(int((e - s).sum()))
            spans.append(len(s))
            sha.append(hashlib.sha256(_kept(data, s, e)).hexdigest())
        return pa.table({id_col: b.side.column(id_col).cast(pa.int64()), "n_bytes": b.lens, "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text))
    return W.find(Scratch(docs.sparkSession, "suffix"), rows, window, q, text, id_col, finish, schema, hot)


def remove(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, q: int = Q, hot: int = W.HOT) -> DataFrame:
    """The table with its columns, repeated bytes gone from ``text``.

    A character is kept whole where a removed run ends inside it, so the column stays valid
    UTF-8.  A null text becomes an empty one.
    """
    schema = docs.schema
    others = [f.name for f in schema if f.name != text]

    def finish(b: W.Batch, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
        kept = pa.array([_whole_chars(d, s, e).decode("utf-8", "replace") for d, s, e in _cut(b, lo, hi)], pa.string())
        return pa.table({f.name: kept if f.name == text else b.side.column(f.name) for f in schema})

    if id_col not in others:
        raise ValueError(f"no column {id_col}")
    return W.find(Scratch(docs.sparkSession, "suffix"), docs, window, q, text, id_col, finish, schema, hot)
