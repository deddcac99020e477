"""BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a block, sorted, are their trie in depth-first order: each word shares
with the one before it the path of their common prefix.  Every trie node keeps one state, the
last token of its prefix's encoding; a child's last token is the longest token that ends there
and stays apart from the last token of what precedes it (exactly one does), so prefixes are
encoded once and a word's tokens are read by walking back.  Words met before are kept in
caches of the Python worker, new words and words that a second block has used; both are bounded in
number, and words over ``WORD_CHARS`` letters are never kept.

Contract: ids equal those of the tokenizers library (byte-level BPE, no special tokens added,
added tokens found in the text become their id); decoding joins the tokens' bytes and reads
them as UTF-8.  A null text counts as empty and gives no tokens; ids may be null or repeat, rows are
never merged; an empty table gives an empty result.  ``encode`` keeps all columns but those named as
its new ones, ``digests`` only the id.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from veilspark.llm.common import ship_package

NEW_WORDS, USED_WORDS, PAIRS, WORD_CHARS = 100_000, 250_000, 200_000, 48
BLOCK_CHARS = 1 << 20
#: Fixed value: the byte-level pre-tokenizer's pattern, white space as Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_FAR = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The letters a byte-level vocabulary is written in: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """One vocabulary: encoder states, caches and the decoder's table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {v: k for k, v in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.id_of = {k: v for k, v in vocab.items() if v not in self.added.values()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merged[x, y] = z
            self.parts.setdefault(z, (x, y))
        # ids rise with the merges' order, on which the states rely
        assert all(z > max(p) for z, p in self.parts.items())
        self._automaton()
        self.apart: dict[int, bool] = {}
        self.raw = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.new: dict[str, bytes] = {}
        self.used: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else lambda t: [t]

    def _automaton(self) -> None:
        """Nodes are prefixes of tokens; ``ends`` has the tokens that end a node's string, longest first."""
        step: dict[int, int] = {}
        token, parent_of = [None], [(0, 0)]
        for k, t in self.id_of.items():
            at = 0
            for b in k:
                to = step.get(at << 8 | b)
                if to is None:
                    step[at << 8 | b] = to = len(token)
                    token.append(None)
                    parent_of.append((at, b))
                at = to
            token[at] = (t, len(k))
        self.fall = fall = [0] * len(token)
        self.step, self.own_steps = step, len(step)
        ends: list[tuple] = [()] * len(token)
        depth = [0] * len(token)
        for n in range(1, len(token)):  # a node's number is above its parent's
            depth[n] = depth[parent_of[n][0]] + 1
        for n in sorted(range(1, len(token)), key=depth.__getitem__):
            at, b = parent_of[n]
            if at:
                f = fall[at]
                while (to := step.get(f << 8 | b)) is None and f:
                    f = fall[f]
                fall[n] = to or 0
            ends[n] = ((token[n],) if token[n] else ()) + ends[fall[n]]
        self.ends = ends
        self.shortcuts: dict[int, int] = {}

    def _move(self, key: int) -> int:
        """A step of the automaton that is not an edge of the tokens' own trie."""
        f, b = key >> 8, key & 255
        while (to := self.step.get(f << 8 | b)) is None and f:
            f = self.fall[f]
        if len(self.shortcuts) > PAIRS:
            self.shortcuts.clear()
        self.shortcuts[key] = to = to or 0
        return to

    def stays_apart(self, x: int, y: int) -> bool:
        """Whether tokens x, y side by side are the encoding of their bytes.

        Undo both tokens' merges, last first, and look for a merge across the border that comes
        before the piece on either side is used up.  Equal merges go from left to right.
        """
        key = x << 20 | y
        x_used = y_used = _FAR
        good = True
        while True:
            z = self.merged.get((x, y), _FAR)
            if z < x_used and z <= y_used and z != _FAR:
                good = False
                break
            if x > y and x in self.parts:
                x_used, x = x, self.parts[x][1]
            elif y in self.parts:
                y_used, y = y, self.parts[y][0]
            elif x in self.parts:
                x_used, x = x, self.parts[x][1]
            else:
                break
        if len(self.apart) > PAIRS:
            self.apart.clear()
        self.apart[key] = good
        return good

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian bytes, found in trie order."""
        made: dict[str, bytes] = {}
        step, short, ends, apart, raw = self.step.get, self.shortcuts.get, self.ends, self.apart.get, self.raw
        last, size_of, node = [-1], [0], [0]  # the states along the path of the current word
        before = b""
        for w, s in sorted((s.encode("utf-8", "replace"), s) for s in words):
            n, top = 0, min(len(w), len(before))
            if w[:top] == before[:top]:
                n = top
            else:
                while w[n] == before[n]:
                    n += 1
            del last[n + 1 :], size_of[n + 1 :], node[n + 1 :]
            at = node[n]
            d = n
            for b in w[n:]:
                d += 1
                key = at << 8 | b
                at = step(key)
                if at is None:
                    at = short(key)
                    if at is None:
                        at = self._move(key)
                for t, size in ends[at]:
                    p = last[d - size]
                    if p < 0:
                        break
                    ok = apart(p << 20 | t)
                    if ok or ok is None and self.stays_apart(p, t):
                        break
                last.append(t)
                size_of.append(size)
                node.append(at)
            out = []
            while d:
                out.append(raw[last[d]])
                d -= size_of[d]
            out.reverse()
            made[s] = b"".join(out)
            before = w
        return made

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [[p for p in self.split(t)] for t in texts]
        words = [[(p if p in self.added else self.find(p)) for p in ps] for ps in pieces]
        here = {w for ws in words for x in ws if not isinstance(x, str) for w in x}
        known = {w: self.used[w] for w in here & self.used.keys()}
        again = {w: self.new.pop(w) for w in here & self.new.keys()}
        fresh = self.learn(here - known.keys() - again.keys())
        if len(self.used) + len(again) > USED_WORDS:
            self.used.clear()
        if len(self.new) + len(fresh) > NEW_WORDS:
            self.new.clear()
        self.used |= again
        self.new |= {w: x for w, x in fresh.items() if len(w) <= WORD_CHARS}
        get = (known | again | fresh).__getitem__
        return [b"".join(self.raw[self.added[x]] if isinstance(x, str) else b"".join(map(get, x)) for x in ws) for ws in words]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK_CHARS):
                size += len(texts[j])
                j += 1
            yield from self.encode_block(texts[i:j])
            i = j

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def forget() -> None:
    """Drop all vocabularies and caches of this worker."""
    _CODECS.clear()


def codec(path: str) -> Codec:
    """The vocabulary at ``path``, loaded once for each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _map(docs: DataFrame, text: str, path: str | None, ids: bool, digests: bool) -> DataFrame:
    ship_package(docs.sparkSession)
    path = path or default_path()
    new = [T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    new += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] * digests
    names = {f.name for f in new}
    keep = [f for f in docs.schema if f.name not in names and (not digests or f.name != text)]
    kept = [f.name for f in keep]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from veilspark.llm.bpe import codec

        c = codec(path)
        for rb in it:
            for at in range(0, rb.num_rows, 512):
                part = rb.slice(at, 512)
                texts = [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                got = list(c.encode(texts))
                cols = [part.column(part.schema.get_field_index(k)) for k in kept]
                cols.append(pa.array([len(x) // 4 for x in got], pa.int64()))
                if ids:
                    flat = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
                    off = np.r_[0, np.cumsum([len(x) // 4 for x in got])].astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(flat)))
                if digests:
                    cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in got]))
                    cols.append(pa.array([hashlib.sha256(c.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest() for x in got]))
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(f.name for f in new)])

    return docs.mapInArrow(work, T.StructType([*keep, *new]))


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The table with ``n_tokens`` and ``ids``; columns of these names are replaced."""
    return _map(docs, text, path, True, False)


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per document: tokens, SHA-256 of the ids and of the text decoded from them."""
    return _map(docs.select(id_col, F.col(text).cast("string").alias(text)), text, path, False, True)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """The table with the text of each id list; a null list gives a null text."""
    ship_package(rows.sparkSession)
    path = path or default_path()
    keep = [f for f in rows.schema if f.name != out]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from veilspark.llm.bpe import codec

        c = codec(path)
        for rb in it:
            texts = [None if x is None else c.decode(x) for x in rb.column(rb.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rb.column(rb.schema.get_field_index(f.name)) for f in keep), pa.array(texts, pa.string())], names=[*(f.name for f in keep), out])

    return rows.mapInArrow(work, T.StructType([*keep, T.StructField(out, T.StringType())]))
