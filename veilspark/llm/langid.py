"""Language id by Bayesian evidence fusion.

log P(lang | row) = text likelihood + log P(declared markup language | lang)
                  + log P(address suffix | lang) + log P(lang | host) + constant.

Text likelihood: letter trigrams hashed to ``BUCKETS``, tempered to ``WEIGHT`` trigrams at most so
that a long text does not drown the rest.  Trained on a sample of different labelled texts,
``MAX_DOCS`` expected and twice as many at most, and ``RARE`` of each language the sample has missed, so
that every labelled language has a class, however many there are.  The other tables come from grouped sums of the text-only posterior
over *all* rows: markup and suffix confusions (languages by languages) and host
priors, smoothed along host, domain and everything.  Host tables are joined, never collected.

Contract: a text without letters (null, empty, digits) is decided by the other evidence, and is
``und`` and rejected if it has neither markup nor suffix evidence; a row is rejected, too, if no
language reaches ``least``.  Rows with null ids or hosts are judged like others (a null host is
one host); rows of one id and one text are judged alike; an empty table gives an empty result;
without labelled rows everything is ``und``.  ``identify`` gives its own columns only, ``keep_known``
those of its input, whatever their names.  Markup is taken off in one pass, in time linear in the
page, closed or not.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilspark.llm.common import Scratch, fresh_worker

BUCKETS, MAX_DOCS, WEIGHT, LEAST, KAPPA, RARE = 1 << 15, 4000, 60.0, 0.5, 8.0, 32
UND = "und"
#: Languages that an address suffix points to.
SUFFIXES = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


def trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket of each trigram of letters, row of each), about 1 MB of text at a time."""
    arr = texts.cast(pa.large_string())
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    fold = np.full(256, 32, np.uint32)
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), side="right")) - 1)
        b = fold[data[off[i] : off[j]]]
        row = np.repeat(np.arange(i, j, dtype=np.int32), np.diff(off[i : j + 1]))
        if len(b) > 2:
            one, two, three = b[:-2], b[1:-1], b[2:]
            ok = (row[:-2] == row[2:]) & (two != 32) & ((one != 32) | (three != 32))
            code = ((one << np.uint32(16) | two << np.uint32(8) | three) * np.uint32(0x9E3779B1)) >> np.uint32(17)
            yield i, j, code[ok], row[:-2][ok]
        else:
            yield i, j, np.zeros(0, np.uint32), np.zeros(0, np.int32)
        i = j


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in it:
        langs = np.array(rb["lang"].to_pylist(), object)
        names = sorted(set(langs))
        at = {k: x for x, k in enumerate(names)}
        which = np.array([at[x] for x in langs], np.int64)
        total = np.zeros((len(names), BUCKETS), np.int64)
        for _, _, code, row in trigrams(rb["text"]):
            total += np.bincount(which[row] * BUCKETS + code, minlength=total.size).reshape(total.shape)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([names[x] for x in k], pa.string()), "b": pa.array(b, pa.int32()), "n": pa.array(total[k, b], pa.int64())})


class TextModel:
    """Log probabilities of trigram buckets for each language."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tempered log likelihood by row and language, trigrams by row)."""
        out, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for i, j, code, row in trigrams(texts):
            c = np.bincount(row - i, minlength=j - i)
            n[i:j] = c
            full = np.flatnonzero(c)
            if len(full):
                out[i + full] = np.add.reduceat(self.logp[code], np.r_[0, np.cumsum(c)[:-1]][full], axis=0)
        m = np.maximum(n, 1)
        return out * (np.minimum(m, WEIGHT) / m)[:, None], n


def visible(html: str) -> str:
    """A page's text: scripts, styles, comments, tags and entities become spaces.

    What is opened and never closed is looked for once, so no page takes more than linear time.
    """
    out, at, none = [], 0, set()

    def end(kind: str, pattern: re.Pattern, start: int) -> int:
        if kind in none:
            return -1
        m = pattern.search(html, start)
        if m is None:
            none.add(kind)
        return m.end() if m else -1

    spot = _MARK.search(html)
    while spot:
        s, e = spot.start(), spot.end()
        if html[s] == "<":
            name = (spot[1] or "").lower()
            e = end(name, _CLOSE[name], s) if name else -1
            if e < 0 and html.startswith("!--", s + 1):
                e = end("!--", _CLOSE["!--"], s + 4)
            if e < 0:
                e = end(">", _CLOSE[">"], s)
        if e < 0:
            e = s + 1  # stays as text
        else:
            out += [html[at:s], " "]
            at = e
        spot = _MARK.search(html, e)
    return "".join([*out, html[at:]])


_MARK = re.compile(r"<(?:(script|style)\b)?|&[a-z0-9#]+;", re.I)
_CLOSE = {k: re.compile(p, re.I) for k, p in (("script", r"</script\s*>"), ("style", r"</style\s*>"), ("!--", "-->"), (">", ">"))}


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, rare: int = RARE) -> TextModel:
    """Fit on whole texts of a hash sample: ``max_docs`` expected, twice as many at most, and ``rare`` of each language it misses."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {k: m for k, m in rows.groupBy(lang).count().collect()}
    n = max(1, sum(sizes.values()))
    place = F.pmod(F.xxhash64(text, lang), F.lit(n))
    chosen = rows.filter(place < max_docs).select(F.col(text).alias("text"), F.col(lang).alias("lang"), place.alias("place"))
    places = sorted(r[0] for r in chosen.groupBy("place", F.xxhash64("text", "lang")).count().select("place").orderBy("place").limit(2 * max_docs + 1).collect())
    top = max_docs if len(places) <= 2 * max_docs else places[2 * max_docs]
    some = chosen.filter(F.col("place") < top).dropDuplicates(["text", "lang"]).select("text", "lang")

    def counted(sample: DataFrame) -> pa.Table:  # languages by buckets at most
        return sample.mapInArrow(_count, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow()

    t = counted(some)
    if missed := sorted(set(sizes) - set(t["lang"].to_pylist())):
        few = rows.filter(F.col(lang).isin(missed)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text")))
        t = pa.concat_tables([t, counted(few.withColumn("nth", nth).filter(F.col("nth") <= rare).select("text", "lang"))])
    names = np.array(t["lang"].to_pylist(), object)
    langs = sorted(set(names))
    counts = np.zeros((BUCKETS, len(langs)))
    for x, k in enumerate(langs):
        on = names == k
        counts[np.asarray(t["b"])[on], x] = np.asarray(t["n"])[on]
    logp = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
    return TextModel(langs, logp.astype(np.float32))


def evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """Rows with ``_text`` replaced by ``ll`` (array of log likelihoods) and ``n_grams``; where ``_html``, it is a page."""
    names = [f.name for f in rows.schema if f.name not in ("_text", "_html")]
    shared = rows.sparkSession.sparkContext.broadcast((model.langs, model.logp))  # languages by buckets: a fixed size

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        m = TextModel(*shared.value)
        k = len(m.langs)
        for rb in it:
            text = rb["_text"]
            if any(page := rb["_html"].to_pylist()):
                text = pa.array([visible(t) if p and t else t for t, p in zip(text.to_pylist(), page)], pa.large_string())
            ll, n = m.scores(text)
            off = pa.array(np.arange(0, (len(n) + 1) * k, k, dtype=np.int32))
            arr = pa.ListArray.from_arrays(off, pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*(rb.column(rb.schema.get_field_index(c)) for c in names), arr, pa.array(n)], names=[*names, "ll", "n_grams"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(work, f"{schema}, ll array<double>, n_grams long")


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(k: int) -> list[Column]:
    return [F.sum(F.get("post", F.lit(i))).alias(f"s{i}") for i in range(k)]


def fuse(scratch: Scratch, rows: DataFrame, model: TextModel, least: float = LEAST, kappa: float = KAPPA) -> DataFrame:
    """Adds lang, confidence and rejected to rows of (…, _text, _html, _markup, _suffix, _host, _domain).

    Markup and suffix are languages or null.  Internal columns begin with an underscore and go.
    """
    k = len(model.langs)
    keep = [c for c in rows.columns if c not in ("_text", "_html", "_markup", "_suffix", "_host", "_domain", "lang", "confidence", "rejected")]
    if not k:
        return rows.select(*keep, F.lit(UND).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"))
    known = F.array(*map(F.lit, model.langs))
    code = lambda c: F.when(F.col(c).isNull(), None).otherwise(F.array_position(known, F.col(c)))  # noqa: E731  0: another one
    rows = rows.withColumns({"_markup": code("_markup"), "_suffix": code("_suffix"), "_host": F.coalesce("_host", F.lit("")), "_domain": F.coalesce("_domain", F.lit(""))})
    table = scratch.table(evidence(rows, model), "evidence")
    post = table.filter("n_grams > 0").withColumn("post", _softmax(F.col("ll")))
    total = [x or 0.0 for x in post.agg(*_sums(k)).first()]
    prior = [(x + 1) / (sum(total) + k) for x in total]

    def confusion(c: str) -> Column:
        some = table.filter(F.col(c).isNotNull()).withColumn("post", F.when(F.col("n_grams") > 0, _softmax(F.col("ll"))))
        got = {r[c]: [r[f"s{i}"] or 0.0 for i in range(k)] for r in some.groupBy(c).agg(*_sums(k)).collect()}
        if not got:
            return F.array(*[F.lit(0.0)] * k)
        of = [sum(v[i] for v in got.values()) for i in range(k)]
        seen = {v: [math.log((got[v][i] + (2.0 if v == i + 1 else 0.1)) / (of[i] + 2.0 + 0.1 * k)) for i in range(k)] for v in got}
        table_ = F.create_map(*[x for v, ws in seen.items() for x in (F.lit(v), F.array(*map(F.lit, ws)))])
        return F.coalesce(F.element_at(table_, F.col(c).cast("int")), F.array(*[F.lit(0.0)] * k))

    domains = post.groupBy("_domain").agg(*_sums(k))
    n = lambda: sum((F.col(f"s{i}") for i in range(k)), F.lit(0.0))
    domains = domains.select("_domain", F.array(*[(F.col(f"s{i}") + kappa * prior[i]) / (n() + kappa) for i in range(k)]).alias("p"))
    hosts = post.groupBy("_host", "_domain").agg(*_sums(k)).join(domains, "_domain")
    hosts = hosts.select("_host", F.col("_domain").alias("_d"), F.array(*[F.ln((F.col(f"s{i}") + kappa * F.get("p", F.lit(i))) / (n() + kappa)) for i in range(k)]).alias("lp"))
    joined = table.join(hosts.withColumnRenamed("_host", "_h"), (F.col("_host") == F.col("_h")) & (F.col("_domain") == F.col("_d")), "left")
    base = F.coalesce("lp", F.array(*[F.lit(math.log(p)) for p in prior]))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joined = joined.withColumn("_post", _softmax(add(add(F.col("ll"), base), add(confusion("_markup"), confusion("_suffix")))))
    best = F.array_max("_post")
    blind = (F.col("n_grams") == 0) & F.col("_markup").isNull() & F.col("_suffix").isNull()
    return joined.select(
        *keep, F.when(blind, F.lit(UND)).otherwise(F.get(known, (F.array_position("_post", best) - 1).cast("int"))).alias("lang"),
        F.when(blind, 0.0).otherwise(F.round(best, 6)).alias("confidence"), (blind | (best < least)).alias("rejected"),
    )


def document_rows(docs: DataFrame, text: str, source: str, keep: list[Column]) -> DataFrame:
    """A document's host is its source; it has neither markup nor address."""
    return docs.select(*keep, F.col(text).cast("string").alias("_text"), F.lit(False).alias("_html"), F.lit(None).cast("string").alias("_markup"), F.lit(None).cast("string").alias("_suffix"), F.concat(F.lit("source:"), F.coalesce(F.col(source), F.lit(""))).alias("_host"), F.lit("source:").alias("_domain"))


def declared(html: str) -> Column:
    """The two letters of the ``lang`` attribute of a page's ``html`` tag."""
    return F.lower(F.regexp_extract(F.col(html), r"""(?is)<html\b[^<>]*?\blang\s*=\s*["']?([a-z]{2})""", 1))


def page_rows(pages: DataFrame, url: str, html: str, keep: list[Column]) -> DataFrame:
    """The page, its ``lang`` attribute, the address suffix (country, else a path language) and host."""
    markup = declared(html)
    host = F.lower(F.regexp_extract(F.col(url), r"(?s)://([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    country = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.element_at(labels, -1))
    path = F.regexp_extract(F.col(url), r"(?s)://[^/?#]*/([a-z]{2})/", 1)
    blank = lambda c: F.when(c != "", c)
    return pages.select(*keep, F.col(html).cast("string").alias("_text"), F.lit(True).alias("_html"), blank(markup).alias("_markup"), F.coalesce(country, blank(path)).alias("_suffix"), host.alias("_host"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("_domain"))


def identify(docs: DataFrame, pages: DataFrame | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document and page: kind, doc_id, page_id, declared, lang, confidence, rejected."""
    scratch = Scratch(docs.sparkSession, "langid")
    model = train(docs, text, lang)
    none = F.lit(None).cast("long")
    rows = document_rows(docs, text, source, [F.lit("document").alias("kind"), F.col("doc_id"), none.alias("page_id"), F.col(lang).alias("declared")])
    if pages is not None:
        keep = [F.lit("page").alias("kind"), none.alias("doc_id"), F.col("page_id"), declared("html").alias("declared")]
        rows = rows.unionByName(page_rows(pages, "url", "html", keep))
    return fuse(scratch, rows, model)


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The table without the rows that language id rejects."""
    scratch = Scratch(docs.sparkSession, "langid")
    model = train(docs, text, lang)
    rows = document_rows(docs, text, source, [F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"), F.col(source).alias("_source")])
    bad = scratch.table(fuse(scratch, rows, model).filter("rejected").select("_id", "_hash", "_source").distinct(), "rejected")
    scratch.drop("evidence")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(source).alias("source"))
    same = rows["id"].eqNullSafe(bad["_id"]) & (rows["hash"] == bad["_hash"]) & rows["source"].eqNullSafe(bad["_source"])
    return rows.join(bad, same, "left_anti").select("row.*")
