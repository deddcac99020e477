"""Substring dedup over word windows by compaction of a de Bruijn graph (see :mod:`debruijn`).

Windows of ``window`` words are edges, and equal ones are one edge.  Repeated edges are compacted to
nonbranching paths by Spark joins; a path's pieces carry source coordinates, and only pieces with
two different ones count.  Documents lose the words that such pieces cover.

Contract: words are ``[^\\x20\\x09-\\x0D]+``; a word goes if a window that covers it also starts
anywhere else, the same document included, judged on the input.  Windows are equal if their words
are, to 128 bits of each word's bytes and of each piece.  Null texts have no words, texts of fewer
words than a window keep all, an empty table gives an empty result, repeated rows (and rows of one
id or of none) count as other documents.  Ids may have any type.  Other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from veilspark.llm import debruijn as G
from veilspark.llm.common import Scratch

WINDOW = 35


def _graph(docs: DataFrame, text: str, id_col: str, window: int) -> G.Graph:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return G.build(Scratch(docs.sparkSession, "debruijn"), rows, "text", "id", window)


def _by_doc(b: G.Batch, on: np.ndarray) -> np.ndarray:
    """Number of words with ``on`` of each document."""
    return np.diff(np.r_[0, np.cumsum(on)][b.bounds])


def _kept(b: G.Batch, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    step = np.zeros(len(b.codes) + 1, np.int64)
    step[lo] += 1
    step[hi] -= 1
    return np.cumsum(step[:-1]) == 0


def _n_paths(b: G.Batch, spots: pa.Table) -> np.ndarray:
    """Distinct paths that each document has a piece of."""
    out = np.zeros(len(b.n_words), np.int64)
    if spots.num_rows:
        starts = spots["starts"].combine_chunks()
        path = spots["path"].combine_chunks().dictionary_encode()
        path = np.repeat(np.asarray(path.indices).astype(np.int64), np.asarray(starts.value_lengths()))
        doc = b.doc[np.asarray(starts.flatten())].astype(np.int64)
        both = np.sort(doc << 32 | path)
        np.add.at(out, both[np.r_[True, both[1:] != both[:-1]]] >> 32, 1)
    return out


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per document: words, words removed, paths met, SHA-256 of the kept words joined by a space."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed", "n_paths")), T.StructField("kept_sha256", T.StringType())])

    def make(b: G.Batch, lo: np.ndarray, hi: np.ndarray, spots: pa.Table) -> pa.Table:
        keep = _kept(b, lo, hi)
        n = _by_doc(b, keep)
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in b.joined(np.flatnonzero(keep), n)]
        return pa.table({id_col: b.side.column("id"), "n_words": b.n_words, "n_removed": b.n_words - n, "n_paths": _n_paths(b, spots), "kept_sha256": pa.array(sha, pa.string())})

    return G.finish(_graph(docs, text, id_col, window), make, schema)


def spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Every walk of a document along a path: id, first word, end word, path, place on it (in words), text."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()),
                           T.StructField("path", T.StringType()), T.StructField("path_word", T.LongType()), T.StructField("path_text", T.StringType())])

    def make(b: G.Batch, lo: np.ndarray, hi: np.ndarray, spots: pa.Table) -> pa.Table:
        walks: dict[tuple, list] = {}
        for n, starts, path, off in zip(*(spots[c].to_pylist() for c in ("n", "starts", "path", "off"))):
            for s in starts:
                walks.setdefault((int(b.doc[s]), path, s - off), []).append((s, s + n, off))
        ids, rows = b.side.column("id").to_pylist(), []
        for (doc, path, _), got in walks.items():
            got.sort()
            at = int(b.bounds[doc])
            while got:
                s, e, off = got.pop(0)
                while got and got[0][0] == e:
                    e = got.pop(0)[1]
                e += b.k - 1
                words = b" ".join(x.as_py() for x in b.words.take(pa.array(b.codes[s:e])))
                rows.append((ids[doc], s - at, e - at, path.hex(), off, words.decode("utf-8", "replace")))
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)], schema=fields)

    return G.finish(_graph(docs, text, id_col, window), make, schema)


def paths(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The compacted graph: one row per path with its length, pieces, and where its first piece is met first."""
    pieces = _graph(docs, text, id_col, window).pieces
    whole = pieces.groupBy("path").agg((F.sum("n") + window - 1).alias("n_words"), F.count("*").alias("n_pieces"),
                                       F.min_by("source", "off").alias("s"), F.min_by("copies", "off").alias("copies"))
    return whole.select(F.lower(F.hex("path")).alias("path"), "n_words", "n_pieces", "copies", F.col("s.id").alias("source_id"), F.col("s.word").alias("source_word"))
