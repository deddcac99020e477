"""Numpy kernels on packed byte or word sequences: rolling hashes and super-k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_GROUP = 1 << 19  # symbols worked on at once; bounds memory whatever a document's length
POS_BITS = U(22)
BYTE_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | U(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer; ``salt`` picks another one of the family."""
    x = x + U((salt * 0xA24BAED4963EE407 + 1) & (2**64 - 1))
    x ^= x >> U(31)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        one = np.full(size, U(_BASE))
        inv = np.full(size, U(pow(_BASE, -1, 2**64)))
        one[0] = inv[0] = 1
        np.multiply.accumulate(one, out=one)
        np.multiply.accumulate(inv, out=inv)
        _POWERS[0] = have = (one, inv)
    return have


def prefix(sym: np.ndarray) -> np.ndarray:
    """Prefix sums of sym[i] * base**i; with ``gram`` they give any substring's hash.  Bytes get table values."""
    sym = BYTE_TABLE[sym] if sym.dtype == np.uint8 else sym
    c = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(sym * powers(len(sym))[0][: len(sym)], out=c[1:])
    return c


def gram(c: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k symbols in a row."""
    n = len(c) - k
    return mix((c[k:] - c[:n]) * powers(n)[1][:n], salt) if n > 0 else np.zeros(0, np.uint64)


def gram_at(c: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the symbols lo..hi for each pair, their number included."""
    top = int(lo.max()) + 1 if len(lo) else 1
    return mix((c[hi] - c[lo]) * powers(top)[1][lo] + (hi - lo).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F), salt)


def doc_groups(bounds: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Cut documents (symbol bounds) into (first, last, lo, hi): documents first..last-1 lie in lo..hi.

    A document over the group size is cut into slices that overlap by window - 1 symbols, so
    each of its windows lies in one slice.
    """
    i, n = 0, len(bounds) - 1
    while i < n:
        lo = int(bounds[i])
        if bounds[i + 1] - lo > _GROUP:
            end = int(bounds[i + 1])
            for s in range(lo, end, _GROUP):
                hi = min(end, s + _GROUP + window - 1)
                if hi - s >= window:
                    yield i, i + 1, s, hi
            i += 1
            continue
        j = int(np.searchsorted(bounds, lo + _GROUP, side="right")) - 1
        j = max(j, i + 1)
        yield i, j, lo, int(bounds[j])
        i = j


def runs(sym: np.ndarray, bounds: np.ndarray, window: int, q: int):
    """Super-k-mers: maximal rows of windows that share one smallest q-gram.

    ``sym``: symbol values of all documents one after another, ``bounds``: where each begins,
    and the end.  Gives for each run its document, first and last window start (absolute), the
    q-gram bucket ``a`` and the identifier ``r`` of the run's whole content.  Equal windows
    always lie in runs of equal ``a``: the leftmost smallest q-gram of a window depends on the
    window alone.
    """
    out: list[tuple] = []
    w = window - q + 1
    for first, last, lo, hi in doc_groups(bounds, window):
        n = hi - lo
        if n < window:
            continue
        c = prefix(sym[lo:hi])
        h = gram(c, q)
        b = np.clip(bounds[first : last + 1] - lo, 0, n)
        lens = np.diff(b)
        did = np.repeat(np.arange(last - first, dtype=np.int32), lens)
        m = (h >> POS_BITS << POS_BITS) | np.arange(len(h), dtype=np.uint64)
        s = 1
        while s * 2 <= w:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        if s < w:
            m = np.minimum(m[: len(m) - (w - s)], m[w - s :])
        ok = did[: len(m)] == did[window - 1 : window - 1 + len(m)]
        new = ok.copy()
        new[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
        s1 = np.flatnonzero(new)
        if not len(s1):
            continue
        at = np.flatnonzero(ok)
        s2 = at[np.r_[np.searchsorted(at, s1[1:]), len(at)] - 1]
        p = (m[s1] & U((1 << int(POS_BITS)) - 1)).astype(np.int64)
        ends = refine(h, s1, q, window) * U(3) + refine(h, s2, q, window) * U(_BASE)
        r = mix(ends + ((s2 - s1) * 64 + (p - s1)).astype(np.uint64), 5)
        out.append((did[s1].astype(np.int64) + first, s1 + lo, s2 + lo, h[p], r))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def refine(h: np.ndarray, at: np.ndarray, q: int, window: int) -> np.ndarray:
    """Bucket identifiers of whole windows from those of q-grams at later offsets.

    Two neighbouring buckets of size s name one of size 2s (the last step overlaps), and the
    names made in one step are what the next step reads.
    """
    if q >= window:
        return h[at]
    size = q if 2 * q >= window else _reach(q, window)
    left = refine(h, at, q, size) if size > q else h[at]
    right = refine(h, at + (window - size), q, size) if size > q else h[at + (window - size)]
    return mix(left * U(3) + right, window)


def _reach(q: int, window: int) -> int:
    size = q
    while 2 * size < window:
        size *= 2
    return size


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes other than 0x20 and 0x09 to 0x0D."""
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit identifier for each word's bytes, worked out in slices of bounded size."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _GROUP, side="right")))
        c = prefix(buf[lo : int(ends[j - 1])])
        out[i:j] = gram_at(c, starts[i:j] - lo, ends[i:j] - lo, 9)
        i = j
    return out | U(1)


def by_key(a: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Order by a, then by ``more``: one fast sort of a, and a full one only where a repeats."""
    o = np.argsort(a)
    s = a[o]
    tie = np.zeros(len(s), bool)
    if len(s) > 1:
        same = s[1:] == s[:-1]
        tie[1:] |= same
        tie[:-1] |= same
    at = np.flatnonzero(tie)
    if len(at):
        sub = o[at]
        o[at] = sub[np.lexsort(tuple(x[sub] for x in reversed(more)) + (a[sub],))]
    return o


def firsts(*cols: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    n = len(cols[0])
    f = np.ones(n, bool)
    if n > 1:
        f[1:] = False
        for c in cols:
            f[1:] |= c[1:] != c[:-1]
    return f


def union_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge half-open intervals; touching ones become one."""
    if not len(lo):
        return lo, hi
    o = np.argsort(lo, kind="stable")
    lo, hi = lo[o], np.maximum.accumulate(hi[o])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.r_[at[1:], len(lo)] - 1]
