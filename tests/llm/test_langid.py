"""Language id: held-out accuracy, evidence of pages, rows without text."""

import random

import pytest

from veilspark.llm import langid

SYL = {"en": ["th", "ing", "wh", "and", "er", "the "], "de": ["sch", "ein", "ung", "keit", "ver", "der "], "fr": ["eau", "oi", "tion", "ment", "qui ", "les "]}


def text(rng, lang, n):
    return "".join(rng.choice(SYL[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs5(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        lang = rng.choice(list(SYL))
        rows.append((i, text(rng, lang, rng.randrange(3, 60)), lang if i % 2 else None, f"src{i % 4}", lang))
    rows += [(1000, None, "en", "src0", None), (1001, "", None, None, None), (1002, "12 34 !!", "fr", "src1", None), (None, "the thing and the thing", None, "src1", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")


def test_held_out(docs5):
    got = {r.doc_id: r for r in langid.identify(docs5.drop("truth")).collect()}
    held = [r for r in docs5.collect() if r.lang is None and r.truth and r.doc_id is not None]
    right = sum(got[r.doc_id].lang == r.truth for r in held)
    assert len(held) > 100 and right / len(held) > 0.97
    assert [got[i].rejected for i in (1000, 1001, 1002)] == [True] * 3 and got[1001].lang == "und"
    assert not any(got[r.doc_id].rejected for r in held)


def test_pages_use_markup_suffix_and_host(spark, docs5):
    rng = random.Random(2)
    rows = [(i, f"http://a.site.org/fr/{i}", f'<html lang="fr"><p>{text(rng, "fr", 30)}</p></html>') for i in range(30)]
    rows += [(100, "http://a.site.org/x", "<html></html>"), (101, "http://other.org/fr/1", "<html lang='fr'></html>"), (102, None, None), (103, "http://a.site.de/", "<b>1</b>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(docs5.drop("truth"), pages).filter("kind = 'page'").collect()}
    assert all(got[i].lang == "fr" for i in range(30))
    assert got[101].lang == "fr" and not got[101].rejected
    assert got[103].lang == "de"
    assert got[100].lang == "und" and got[102].rejected


def test_keep_known(docs5):
    kept = langid.keep_known(docs5)
    assert kept.columns == docs5.columns
    assert {r.doc_id for r in docs5.collect()} - {r.doc_id for r in kept.collect()} == {1000, 1001, 1002}


def test_empty_and_unlabelled(spark, no_docs):
    from pyspark.sql import functions as F

    df = no_docs.withColumn("lang", F.lit("en"))
    assert langid.identify(df).count() == 0 and langid.keep_known(df).count() == 0
    one = spark.createDataFrame([(1, "abc", None, "s")], "doc_id long, text string, lang string, source string")
    assert langid.identify(one).first().lang == "und"


def test_every_labelled_language_has_a_class(spark):
    import random

    def texts(k, n):
        rng = random.Random(k)
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(30)]
        return [" ".join(rng.choice(words) for _ in range(40)) for _ in range(n)]

    rows = [(f"l{k:02}", t) for k in range(70) for t in texts(k, 4 if k < 68 else 3)]
    docs = spark.createDataFrame([(i, t, k, "s") for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and all(r.lang == r.declared and not r.rejected for r in got)
    assert len(langid.train(docs, max_docs=5).langs) == 70


def test_visible_text_and_pages_that_never_close():
    import re
    import time

    from veilspark.llm.langid import visible

    plain = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;")
    cases = ["", "a<b", "<p>x</p>", "<script>a<b</SCRIPT >y", "<style>z", "<!-- a > b -->c<!-- d", "&amp;e&nope f", "<scripts>g</scripts>", "<a <b>h</b", "<!--x--", "x<", "<style></script></style>k", "<STYLE a>l</style\n>m"]
    for c in cases + ["".join(cases)]:
        assert visible(c) == plain.sub(" ", c)
    for piece in ("<style ", "<!--", "<", "<script>", "</script", "&a", "<html lang", "<a b='"):
        began = time.time()
        visible(piece * (10**6 // len(piece)))
        assert time.time() - began < 5


def test_unclosed_html_tags_end_soon(spark):
    from pyspark.sql import functions as F
    from veilspark.llm import langid

    pages = spark.createDataFrame([("http://a.de/x", "<html " * 150_000 + '<html lang="de">'), ("x", None)], "url string, html string")
    got = langid.page_rows(pages, "url", "html", [F.lit(1).alias("k")]).select("_markup", "_suffix", "_host").collect()
    assert sorted(map(tuple, got), key=str) == [("de", "de", "a.de"), (None, None, "")]


def plain_fusion(rows, model, least=langid.LEAST, kappa=langid.KAPPA):
    """(lang, confidence, rejected) of rows (text, is a page, markup, suffix, host, domain)."""
    import math

    import pyarrow as pa

    k, langs = len(model.langs), model.langs
    ll, n = model.scores(pa.array([langid.visible(t) if page and t else t for t, page, *_ in rows], pa.large_string()))
    ll = [list(map(float, x)) for x in ll]

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    def added(table, key, x):
        table[key] = [a + b for a, b in zip(table.get(key, [0.0] * k), x)]

    total, hosts, domains, said = [0.0] * k, {}, {}, ({}, {})
    for x, m, (_, _, markup, suffix, host, domain) in zip(ll, n, rows):
        post = soft(x) if m else [0.0] * k
        total = [a + b for a, b in zip(total, post)]
        if m:
            added(hosts, (host or "", domain or ""), post)
            added(domains, domain or "", post)
        for table, value in zip(said, (markup, suffix)):
            if value is not None:
                added(table, value if value in langs else "", post)
    prior = [(x + 1) / (sum(total) + k) for x in total]
    out = []
    for x, m, (_, _, markup, suffix, host, domain) in zip(ll, n, rows):
        score = list(x)
        if (host or "", domain or "") in hosts:
            s, d = hosts[host or "", domain or ""], domains[domain or ""]
            up = [(a + kappa * p) / (sum(d) + kappa) for a, p in zip(d, prior)]
            score = [a + math.log((b + kappa * u) / (sum(s) + kappa)) for a, b, u in zip(score, s, up)]
        else:
            score = [a + math.log(p) for a, p in zip(score, prior)]
        for table, value in zip(said, (markup, suffix)):
            if value is not None:
                of = [sum(v[i] for v in table.values()) for i in range(k)]
                got = table[value if value in langs else ""]
                score = [a + math.log((g + (2.0 if value == lang else 0.1)) / (o + 2.0 + 0.1 * k)) for a, g, o, lang in zip(score, got, of, langs)]
        post = soft(score)
        blind = not m and markup is None and suffix is None
        out.append(("und", 0.0, True) if blind else (langs[post.index(max(post))], max(post), max(post) < least))
    return out


def test_posterior_against_plain_python(spark, docs5):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    rows = [(i, f"http://{'ab'[i % 2]}.site{i % 3}.{rng.choice(['de', 'org', 'fr'])}/{rng.choice(['fr', 'xx', 'page'])}/{i}", f'<html lang="{rng.choice(["de", "fr", "zz"])}"><p>{text(rng, rng.choice(list(SYL)), i % 4)}</p></html>') for i in range(60)]
    pages = spark.createDataFrame(rows + [(100, None, None), (101, "http://q.org/", "<b>12</b>")], "page_id long, url string, html string")
    docs = docs5.drop("truth").filter("doc_id is not null")
    got = langid.identify(docs, pages).collect()
    keep = [F.lit("x").alias("k"), F.col("doc_id").alias("i")]
    parts = langid.document_rows(docs, "text", "source", keep).unionByName(langid.page_rows(pages, "url", "html", [F.lit("y").alias("k"), F.col("page_id").alias("i")]))
    parts = parts.collect()
    want = plain_fusion([(r._text, r._html, r._markup, r._suffix, r._host, r._domain) for r in parts], langid.train(docs))
    by = {(r.k, r.i): w for r, w in zip(parts, want)}
    assert len(got) == len(by) and len({w[0] for w in want}) == 4
    for r in got:
        lang, sure, rejected = by["x" if r.kind == "document" else "y", r.doc_id if r.kind == "document" else r.page_id]
        assert (r.lang, r.rejected) == (lang, rejected) and abs(r.confidence - sure) < 1e-5


def test_repeated_and_long_texts(spark):
    rows = [(i, "the thing and the other thing", "en", "s") for i in range(400)] + [(1000 + i, "eau oi tion ment qui les " * (1 + i % 3), "fr", "s") for i in range(5)]
    rows.append((2000, "der keit ung " * 100_000, None, "t"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train(docs, max_docs=20, rare=4)
    assert set(model.langs) == {"en", "fr"}
    assert len(langid.identify(docs).collect()) == len(rows)
