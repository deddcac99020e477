"""Blocks of words, redaction, OCR routing."""

import time

from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.operators import pages
from veilspark.plans.engine import Engine
from veilspark.config import EngineConfig
from veilspark.sources.files import WORD_SCHEMA

CONFIG = EngineConfig()


def words(spark, rows):
    """(page, block, line, word, text) with a box of its own for each."""
    return spark.createDataFrame([("d", p, b, ln, w, t, 10.0 * w, 10.0 * ln, 10.0 * w + 8, 10.0 * ln + 8) for p, b, ln, w, t in rows], WORD_SCHEMA)


def test_hyphen_join(spark):
    w = words(spark, [(0, 0, 0, 1, "Александро-"), (0, 0, 0, 0, "Фамилия:"), (0, 0, 1, 0, "ва"), (0, 0, 1, 1, "здесь"), (0, 1, 0, 0, "Пункт"), (0, 1, 0, 1, "-"), (0, 1, 1, 0, "Далее"), (0, 2, 0, 0, "  ")])
    got = pages.blocks(pages.page_words(w)).orderBy("block_no").collect()
    assert [b.text for b in got] == ["Фамилия: Александрова здесь", "Пункт -\nДалее"]
    for b in got:
        assert all(b.text[x.start : x.end] == x.text for x in b.words)


def plain_join(rows):
    """(text, [(text, start, end)]) of one block's (line, word, text), word by word."""
    text, out, line = "", [], None
    for ln, _, w in sorted(rows):
        if out and ln != line and len(out[-1][0]) > 1 and out[-1][0].endswith("-"):
            text = text[:-1]
            out[-1] = (out[-1][0][:-1], out[-1][1], out[-1][2] - 1)
        elif out:
            text += " " if ln == line else "\n"
        out.append((w, len(text), len(text) + len(w)))
        text, line = text + w, ln
    return text, out


def test_long_block(spark):
    """A block costs its own length, not its square."""
    rows = [(0, 0, i // 7, i, f"ж{i}" + "-" * (i % 5 == 0)) for i in range(40_000)]
    w = pages.page_words(words(spark, rows))
    began = time.monotonic()
    got = pages.blocks(w).collect()
    assert time.monotonic() - began < 60
    text, places = plain_join([r[2:] for r in rows])
    assert [b.text for b in got] == [text] and [(x.text, x.start, x.end) for x in got[0].words] == places


def test_blocks_over_batch_edges(spark):
    """Blocks that end at, begin at or span Arrow batches, with null keys, agree with a plain loop; nothing is folded."""
    import random

    rnd, rows = random.Random(3), []
    for p in (None, 0, 1):
        for b in (None, 0, 1, 2, 3):
            rows += [(p, b, rnd.randrange(4), i, rnd.choice(["-", "a-", "яб-", "слово", "x", "😀-"])) for i in range(rnd.choice([1, 2, 10, 25]))]
    w = pages.page_words(words(spark, rows)).coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10")
    try:
        df = pages.blocks(w)
        got = {(b.page, b.block_no): (b.text, [(x.text, x.start, x.end) for x in b.words]) for b in df.collect()}
    finally:
        spark.conf.unset(key)
    assert got == {k: plain_join([r[2:] for r in rows if r[:2] == k]) for k in {r[:2] for r in rows}}
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_redaction(spark):
    rows = [(0, 0, 0, 0, "ИНН:"), (0, 0, 0, 1, "770708-"), (0, 0, 1, 0, "3893"), (1, 0, 0, 0, "см."), (1, 0, 0, 1, "https://a.example/x"), (1, 0, 0, 2, "a@b.ru")]
    w = pages.page_words(words(spark, rows))
    e = Engine(spark, CONFIG)
    boxes, summary = e.redact_pages(w)
    assert sorted(b.text for b in boxes.collect()) == ["3893", "770708", "a@b.ru"]
    s = summary.first()
    assert (s.pages_processed, s.total_spans_redacted, s.redacted_by_type) == (2, 2, {"EMAIL": 1, "INN": 1})
    assert {b.text for b in e.redact_pages(w, redact_urls=True)[0].collect()} == {"3893", "770708", "a@b.ru", "https://a.example/x"}
    assert {b.text for b in e.redact_pages(w, entity_types=["URL"])[0].collect()} == {"https://a.example/x"}
    b = boxes.filter("text = '3893'").first()
    assert (b.x0, b.y0, b.x1, b.y1) == (-2.0, 8.0, 10.0, 20.0)
    assert e.detect_pages(w).first().pages == {"1": {"INN": 1}, "2": {"URL": 1, "EMAIL": 1}}
    text, table = e.mask_pages(w)
    t = text.first().text
    assert t.startswith("--- Страница 1 ---\nИНН: <INN_") and "\n\n--- Страница 2 ---\n" in t and table.count() == 3
    found = pages.matched_words(e.detect(pages.blocks(w)))
    assert sorted(r.text for r in pages.surviving_words(found).collect()) == ["https://a.example/x", "ИНН:", "см."]


def mails(spark, n=20_000):
    """One block of n words, every fifth a mail address."""
    return pages.page_words(words(spark, [(0, 0, i // 7, i, f"u{i}@ex.org" if i % 5 == 0 else f"w{i}") for i in range(n)]))


def test_many_entities_of_a_block(spark):
    """Offsets and merging cost a text's spans, not their square."""
    found = Engine(spark, CONFIG).detect(pages.blocks(mails(spark, 150_000)), kinds=["EMAIL"])
    began = time.monotonic()
    row = found.first()
    assert time.monotonic() - began < 60
    assert [row.text[s.start : s.end] for s in row.spans] == [s.text for s in row.spans] == [f"u{i}@ex.org" for i in range(0, 150_000, 5)]
    assert [tuple(r) for r in pages.entity_counts(found).collect()] == [("d", 0, "EMAIL", 30_000)]


def test_many_matched_words(spark):
    """Words meet spans by a search, not one by one."""
    m = pages.matched_words(Engine(spark, CONFIG).detect(pages.blocks(mails(spark)), kinds=["EMAIL"]))
    began = time.monotonic()
    row = m.select("words", F.size("hits").alias("n")).first()
    assert time.monotonic() - began < 60
    assert row.n == 4000 and [w.text for w in row.words if w.matched] == [f"u{i}@ex.org" for i in range(0, 20_000, 5)]


def test_matches_agree_with_a_plain_loop(spark):
    """Spans over parts of words, over gaps, over each other and out of order."""
    import random

    rnd, rows = random.Random(11), []
    for n in range(60):
        at, ws = 0, []
        for i in range(rnd.randrange(0, 30)):
            size = rnd.randint(1, 6)
            ws.append((f"w{i}", at, at + size, 0.0, 0.0, 1.0, 1.0))
            at += size + rnd.randint(0, 2)
        rows.append((str(n), 0, "text", 0, ws, [(a := rnd.randrange(0, at + 3), a + rnd.randint(1, 9), "x", rnd.choice(["URL", "INN"]), "pattern", 0.9) for _ in range(rnd.randrange(0, 12))]))
    df = spark.createDataFrame(rows, f"doc string, page int, origin string, block_no int, words array<{pages.WORD}>, spans {S.SPANS}")
    got = {r.doc: ([tuple(s) for s in r.hits], [w.matched for w in r.words]) for r in pages.matched_words(df).collect()}
    for doc, _, _, _, ws, spans in rows:
        hits = [s for s in spans if s[3] != "URL" and any(w[1] < s[1] and w[2] > s[0] for w in ws)]
        assert got[doc] == (hits, [any(w[1] < s[1] and w[2] > s[0] for s in hits) for w in ws])


def test_many_boxes(spark):
    """Boxes of a long block, each with its padding."""
    boxes = pages.redaction_boxes(pages.matched_words(Engine(spark, CONFIG).detect(pages.blocks(mails(spark)), kinds=["EMAIL"])))
    began = time.monotonic()
    got = {(b.text, b.x0, b.y0, b.x1, b.y1) for b in boxes.collect()}
    assert time.monotonic() - began < 60
    assert got == {(f"u{i}@ex.org", 10.0 * i - 2, 10.0 * (i // 7) - 2, 10.0 * i + 10, 10.0 * (i // 7) + 10) for i in range(0, 20_000, 5)}


def test_summary_of_a_long_block(spark):
    _, summary = pages.redact(mails(spark), config=CONFIG, kinds=["EMAIL"])
    began = time.monotonic()
    s = summary.first()
    assert time.monotonic() - began < 60
    assert (s.pages_processed, s.total_spans_redacted, s.redacted_by_type) == (1, 4000, {"EMAIL": 4000})


def test_ocr_routing(spark):
    layer = words(spark, [(0, 0, 0, 0, "слой")])
    ocr = spark.createDataFrame([("d", 0, 0, 0, 0, "слой", 1.0, 1.0, 7.0, 7.0), ("d", 0, 0, 5, 0, "картинка", 0.0, 50.0, 8.0, 58.0), ("d", 1, 0, 0, 0, "скан", 0.0, 0.0, 8.0, 8.0)], WORD_SCHEMA)
    flags = spark.createDataFrame([("d", 0, True), ("d", 1, False)], "doc string, page int, has_images boolean")
    assert sorted(r.text for r in pages.page_words(layer, ocr, flags).collect()) == ["картинка", "скан", "слой"]
    assert sorted(r.text for r in pages.page_words(layer, ocr).collect()) == ["скан", "слой"]
    scaled = pages.scaled(ocr.unionByName(words(spark, [(2, 0, 0, 0, " ")])))
    assert scaled.count() == 3 and scaled.filter("text = 'картинка'").first().y0 == 50 / 3


def test_fonts(spark):
    w = words(spark, [(0, 0, 0, 0, "a"), (0, 0, 3, 0, "b")])
    runs = spark.createDataFrame([("d", 0, 2, "ABCDEF+Arial", 9.0, 0xFF8000, 0.0, 0.0, 8.0, 8.0), ("d", 0, 1, "Times", 9.0, 0, 0.0, 0.0, 8.0, 8.0)], "doc string, page int, run_no int, font string, size double, color int, x0 double, y0 double, x1 double, y1 double")
    got = {r.line_no: r for r in pages.font_run_of_word(w, runs).collect()}
    assert got[0].font == "Times" and got[3].font is None
    one = pages.font_run_of_word(w, runs.filter("run_no = 2")).filter("line_no = 0").first()
    assert (one.font, one.red, one.green, one.blue) == ("Arial", 1.0, 128 / 255, 0.0)
    assert spark.range(1).select(pages.font_alias(F.lit("x"))).first()[0] == "PG11f6ad8e"


def test_fonts_of_many_runs(spark):
    """Boxes of all sizes, equal ones and ones without an end agree with a plain loop, and no word meets all runs of its page."""
    import random

    rnd, inf, nan = random.Random(5), float("inf"), float("nan")
    box = lambda: (x := rnd.uniform(-50, 500), y := rnd.uniform(-50, 500), x + 2 ** rnd.uniform(-6, 8), y + 2 ** rnd.uniform(-6, 6))
    w = [("d", p, 0, 0, i, "w", *box()) for p in (0, 1) for i in range(300)] + [("d", 0, 0, 0, 300, "w", None, 0.0, 1.0, 1.0), ("d", 0, 0, 0, 301, "w", 1e300, 0.0, 1e300, 9.0)]
    odd = [(-inf, 10.0, inf, 20.0), (9.0, 9.0, 3.0, 3.0), (None, 0.0, 9.0, 9.0), (0.0, 30.0, nan, 40.0), (7.0, 7.0, 7.0, 7.0), (1e300, -1e308, 1e300, 1.7e308)]
    r = [(0, i, *box()) for i in range(200)] + [(0, 200 + i, *b) for i, b in enumerate(odd)]
    r += [(0, 300 + n, *x[2:]) for n, x in enumerate(r[:50])] + [(0, None, 0.0, 0.0, 500.0, 500.0)]
    runs = spark.createDataFrame([("d", p, n, "F", 9.0, 0, *b) for p, n, *b in r], "doc string, page int, run_no int, font string, size double, color int, x0 double, y0 double, x1 double, y1 double")
    got = pages.font_run_of_word(spark.createDataFrame(w, WORD_SCHEMA), runs)

    def holds(x, b):
        if None in b or x[6] is None:
            return False
        cx, cy = (x[6] + x[8]) / 2, (x[7] + x[9]) / 2
        return b[0] - 1 <= cx and (cx <= b[2] + 1 or b[2] != b[2]) and b[1] - 1 <= cy <= b[3] + 1

    want = {(x[1], x[4]): min((n for p, n, *b in r if p == x[1] and n is not None and holds(x, b)), default=None) for x in w}
    assert {(x.page, x.word_no): x.run_no for x in got.collect()} == want and len(set(want.values())) > 20
    assert "gx" in got._jdf.queryExecution().optimizedPlan().toString()


def test_empty(spark):
    w = pages.page_words(words(spark, [(0, 0, 0, 0, "x")]).limit(0))
    boxes, summary = Engine(spark, CONFIG).redact_pages(w)
    assert boxes.count() == 0 and summary.count() == 0
