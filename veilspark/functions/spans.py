"""Algebra of half-open character ranges, on arrays within a row.

Offsets are code points.  A span is (start, end, text, entity_type, source, confidence).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from veilspark.functions import fixed as X

SPAN = "struct<start:int,end:int,text:string,entity_type:string,source:string,confidence:double>"
SPANS = f"array<{SPAN}>"
RANGES = "array<struct<start:int,end:int>>"
Prefer = Callable[[Column, Column], Column]


def none(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def make(start: Column, end: Column, text: Column, entity_type, source, confidence) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    cols = {"start": start.cast("int"), "end": end.cast("int"), "text": text, "entity_type": lit(entity_type), "source": lit(source), "confidence": lit(confidence).cast("double")}
    return F.struct(*[v.alias(k) for k, v in cols.items()])


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x bound as a lambda's variable: however often it is named, it is planned and computed once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def running(xs: Column, use: Callable[[Column, Column], Column] = lambda before, x: before + x) -> Column:
    """Running sum (or maximum and the like) of an array, in doubling steps: a fold that grows an array copies it for every element."""
    steps = F.filter(F.array(*[F.lit(1 << n) for n in range(31)]), lambda p: p < F.size(xs))

    def step(acc: Column, p: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i < p, x).otherwise(use(F.get(acc, i - p), x)))

    return F.aggregate(steps, xs, step)


def scan(text: Column, pattern: str) -> Column:
    """Every match from left to right: array of (start, end, text).

    The gaps between matches (``split``) and the matches line up, so their lengths add up to
    the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), (F.length(g) + F.length(m)).alias("n")))
    pairs = F.filter(pairs, lambda p: p.m.isNotNull())
    kind = "array<struct<start:int,end:int,text:string>>"

    def placed(ps: Column) -> Column:
        return F.zip_with(ps, once(F.transform(ps, lambda p: p.n), lambda n: running(n)), lambda p, end: F.struct((end - F.length(p.m)).alias("start"), end.alias("end"), p.m.alias("text")))

    return F.when(text.rlike(pattern), once(pairs, placed)).otherwise(none(kind))


def in_order(spans: Column) -> Column:
    """Sorted by start, longest first; equal ranges keep their places."""
    keyed = F.transform(spans, lambda s, i: F.struct(s.start.alias("a"), (-s.end).alias("b"), i.alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k.s)


def groups(spans: Column, apart: Callable[[Column, Column], Column], use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(first place, place after the last, end)`` of each group of sorted spans; one begins where ``apart(start, greatest end before)``."""

    def heads(ends: Column) -> Column:
        return F.filter(F.transform(spans, lambda s, i: i), lambda i: (i == 0) | apart(F.get(spans, i).start, F.get(ends, i - 1)))

    def each(ends: Column, firsts: Column) -> Column:
        after = lambda k: F.coalesce(F.get(firsts, k + 1), F.size(spans))
        return F.transform(firsts, lambda i, k: use(i, after(k), F.get(ends, after(k) - 1)))

    ends = once(F.transform(spans, lambda s: s.end), lambda e: running(e, F.greatest))
    return once(ends, lambda e: once(heads(e), lambda firsts: each(e, firsts)))


def merge(spans: Column, text: Column, prefer: Prefer) -> Column:
    """Union overlapping spans (touching ones stay apart); ``prefer`` gives type, source and confidence.

    A fold from left to right over each group of overlapping spans: each span meets what has been merged so far.
    """

    def step(last: Column, s: Column) -> Column:
        end = F.greatest(last.end, s.end)
        won = prefer(last, s)
        return make(last.start, end, cut(text, last.start, end), won.entity_type, won.source, won.confidence)

    def merged(ss: Column) -> Column:
        return groups(ss, lambda start, end: start >= end, lambda i, after, end: F.aggregate(F.slice(ss, i + 2, after - i - 1), F.get(ss, i), step))

    return once(spans, lambda all_: F.when(F.size(all_) < 2, all_).otherwise(once(in_order(all_), merged)))


def greater_end(kept: Column, new: Column) -> Column:
    return F.when(new.end > kept.end, new).otherwise(kept)


def first(kept: Column, new: Column) -> Column:
    return kept


def existing(kept: Column, new: Column) -> Column:
    """A span of another layer beats one of the deny list."""
    return F.when((kept.source == "deny") & (new.source != "deny"), new).otherwise(kept)


def by_evidence(kept: Column, new: Column) -> Column:
    """Equal ranges: the type with better evidence; else the one that ends later."""

    def pair(a: str, b: str) -> Column:
        return ((kept.entity_type == a) & (new.entity_type == b)) | ((kept.entity_type == b) & (new.entity_type == a))

    def of(kind: str) -> Column:
        return F.when(kept.entity_type == kind, kept).otherwise(new)

    surer = F.when(kept.confidence == new.confidence, of("PASSPORT")).when(kept.confidence > new.confidence, kept).otherwise(new)
    policy = F.when(of("OMS").confidence >= X.OMS_PREFERRED, of("OMS")).otherwise(of("CARD"))
    same = (kept.start == new.start) & (kept.end == new.end)
    return (
        F.when(same & (pair("PASSPORT", "INN") | pair("PHONE", "INN")), of("INN"))
        .when(same & pair("PASSPORT", "DRIVER_LICENSE"), surer)
        .when(same & pair("CARD", "OMS"), policy)
        .when(same & pair("URL", "TELEGRAM"), of("TELEGRAM"))
        .otherwise(greater_end(kept, new))
    )


def subtract(span: Column, covering: Column, text: Column) -> Column:
    """What is left of a span outside the covering spans, as spans of the same kind."""
    hits = F.filter(covering, lambda c: (c.start < span.end) & (c.end > span.start))
    gaps = F.array_sort(F.transform(hits, lambda c: F.struct(c.start.alias("start"), c.end.alias("end"))))

    def piece(a: Column, b: Column) -> Column:
        return F.when(a < b, F.array(make(a, b, cut(text, a, b), span.entity_type, span.source, span.confidence))).otherwise(none())

    def step(acc: Column, c: Column) -> Column:
        return F.struct(F.greatest(acc.at, c.end).alias("at"), F.concat(acc.out, piece(acc.at, c.start)).alias("out"))

    rest = F.aggregate(gaps, F.struct(span.start.alias("at"), none().alias("out")), step, lambda a: F.concat(a.out, piece(a.at, span.end)))
    return F.when(F.size(hits) == 0, F.array(span)).otherwise(rest)


def union(ranges: Column) -> Column:
    """Union of ranges: overlapping and touching ones join, empty ones go."""
    bare = F.array_sort(F.transform(F.filter(ranges, lambda r: r.end > r.start), lambda r: F.struct(r.start.alias("start"), r.end.alias("end"))))
    return once(bare.cast(RANGES), lambda rs: groups(rs, lambda start, end: start > end, lambda i, after, end: F.struct(F.get(rs, i).start.alias("start"), end.alias("end"))))


def overlap(start: Column, end: Column, ranges: Column) -> Column:
    """Characters of [start, end) inside disjoint ranges."""
    each = F.transform(ranges, lambda r: F.greatest(F.lit(0), F.least(end, r.end) - F.greatest(start, r.start)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)
