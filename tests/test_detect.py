"""Detection: golden texts, thresholds, ties, lists, context, secrecy of entries."""

from datetime import date

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from veilspark.config import EngineConfig, InvalidConfidenceError, InvalidListEntryError
from veilspark.functions import spans as S
from veilspark.operators import lists
from veilspark.operators.detect import detect, entity_counts, exploded, split_by_length
from veilspark.operators.morphology import Morphology
from veilspark.operators.ner import ColumnNer, PandasNer, RuleNer

CONFIG = EngineConfig(today=date(2026, 10, 3))
GOLDEN = [
    ("номер 4510123456", []), ("номер 45 10 123456", [("45 10 123456", "PASSPORT")]), ("заказ № 45 10 123456", []),
    ("Заказчик: паспорт 45 10 123456", [("45 10 123456", "PASSPORT")]), ("паспорт\n4510123456", []),
    ("паспорт 45 10 123456", [("45 10 123456", "PASSPORT")]), ("паспорт 45-10-123456", [("45-10-123456", "PASSPORT")]), ("паспорт 4510 123456", [("4510 123456", "PASSPORT")]),
    ("номер 112-233-445 95", [("112-233-445 95", "SNILS")]), ("номер 11223344596", []), ("СНИЛС 11223344596", [("11223344596", "SNILS")]),
    ("товары по 12.5, 3.7 за штуку", []), ("точка 55.751244, 37.618423", [("55.751244, 37.618423", "COORDS")]), ("координаты 55.75, 37.61", [("55.75, 37.61", "COORDS")]),
    ("55°45'07\" N 37°37'04\" E", [("55°45'07\" N 37°37'04\" E", "COORDS")]),
    ("версия 1.2.3.4", []), ("релиз v10.0.19.42", []), ("IP-адрес 192.168.1.10", [("192.168.1.10", "IP")]), ("адрес, версия 192.168.1.10", []), ("клиент 84.201.12.5", []),
    ("заказ № a@b.ru", [("a@b.ru", "EMAIL")]), ("заказ № 4111 1111 1111 1111", [("4111 1111 1111 1111", "CARD")]),
    ("БИК 044525225\n40702810200000012345", [("40702810200000012345", "BANK_ACCOUNT")]), ("реквизиты: 40702 810 2 0000 0012345", [("40702 810 2 0000 0012345", "BANK_ACCOUNT")]),
    ("трек-номер 40702810200000012345", []), ("машина А123ВС77", [("А123ВС77", "CAR_PLATE")]), ("К777ХН 799 стоит", [("К777ХН 799", "CAR_PLATE")]), ("артикул А123ВС77", []), ("ХА123ВС77", []),
    ("водительское удостоверение 99 01 123456", [("99 01 123456", "DRIVER_LICENSE")]), ("в/у 77 ТТ 123456", [("77 ТТ 123456", "DRIVER_LICENSE")]),
    ("номер 1234567890123452", [("1234567890123452", "CARD")]), ("полис 4111 1111 1111 1111", [("4111 1111 1111 1111", "OMS")]),
    ("родился 05.03.1990, а поступил 01.09.2008", [("05.03.1990", "BIRTHDATE")]), ("дата рождения 31.02.1990", []), ("05.03.1990 г.р.", [("05.03.1990", "BIRTHDATE")]),
    ("tg: @ivan_petrov", [("@ivan_petrov", "TELEGRAM")]), ("пишите @ivan_petrov без слов", []), ("вот https://t.me/ivan_petrov", [("https://t.me/ivan_petrov", "TELEGRAM")]), ("ivan_petrov@example.com", [("ivan_petrov@example.com", "EMAIL")]),
    ("звонили с номера 9161234568 вчера", [("9161234568", "PHONE")]), ("ИНН 7707083893", [("7707083893", "INN")]), ("КПП 771234234, БИК 044525225", [("771234234", "KPP")]),
    ("ОГРН 1027700132195", [("1027700132195", "OGRN")]), ("см. https://example.org/a?b=1 тут", [("https://example.org/a?b=1", "URL")]),
    ("\U0001f600 a@b.ru и \U0001f600 c@d.ru", [("a@b.ru", "EMAIL"), ("c@d.ru", "EMAIL")]), (None, []), ("", []), ("без чисел", []),
]


def run(spark, rows, **options):
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    return detect(df, config=CONFIG, **options).orderBy("id").collect()


def test_golden(spark):
    bad = []
    for (text, want), r in zip(GOLDEN, run(spark, [t for t, _ in GOLDEN])):
        got = [(s.text, s.entity_type) for s in r.spans]
        bad += [(text, got)] if got != want else []
        assert all(text[s.start : s.end] == s.text for s in r.spans)
    assert not bad


def test_threshold(spark):
    low = run(spark, ["номер 4510123456", "клиент 84.201.12.5"], min_confidence=0.4)
    assert [[(s.entity_type, s.confidence) for s in r.spans] for r in low] == [[("PASSPORT", 0.4)], [("IP", 0.45)]]
    for bad in (-0.1, 1.1, "x", True):
        with pytest.raises(InvalidConfidenceError):
            run(spark, ["a"], min_confidence=bad)


def fold(spans, prefer):
    out = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and s[0] < out[-1][1]:
            k = out[-1]
            out[-1] = (k[0], max(k[1], s[1]), prefer(k, s)[2])
        else:
            out.append(s)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 9), st.sampled_from("ABC")), max_size=7), min_size=1, max_size=20))
def test_merge_is_the_fold(spark, cases):
    rows = [(i, [(a, a + n, k) for a, n, k in c]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, x array<struct<a:int,b:int,k:string>>")
    made = F.transform("x", lambda s: S.make(s.a, s.b, F.lit(""), s.k, "pattern", 1.0))
    df = df.select("id", S.merge(made, F.lit("x" * 40), S.greater_end).alias("g"), S.merge(made, F.lit("x" * 40), S.first).alias("f"), S.union(made).alias("u"))
    for (i, spans), r in zip(rows, df.orderBy("id").collect()):
        assert [(s.start, s.end, s.entity_type) for s in r.g] == fold(spans, lambda k, s: s if s[1] > k[1] else k)
        assert [(s.start, s.end, s.entity_type) for s in r.f] == fold(spans, lambda k, s: k)
        covered = {c for a, b, _ in spans for c in range(a, b)}
        assert {c for s in r.u for c in range(s.start, s.end)} == covered
        assert all(p.end < n.start for p, n in zip(r.u, r.u[1:]))


def test_subtract(spark):
    text = F.lit("x" * 30)
    ner, pat = S.make(F.lit(0), F.lit(23), F.lit(""), "PER", "natasha", 0.85), S.make(F.lit(5), F.lit(15), F.lit(""), "PHONE", "pattern", 0.95)
    got = spark.range(1).select(S.subtract(ner, F.array(pat), text).alias("x"), S.subtract(ner, S.none(), text).alias("y")).first()
    assert [(s.start, s.end, s.entity_type) for s in got.x] == [(0, 5, "PER"), (15, 23, "PER")] and [(s.start, s.end) for s in got.y] == [(0, 23)]


def test_lists(spark):
    texts = ["ПРОЕКТ заря идёт", "проекта Заря", "ИНН 7707083893", "пишите a@b.ru или c@d.ru", "проект (Заря) проект заря"]
    got = run(spark, texts, deny=["Проект Заря", "проект"], allow=["7707083893", "A@B.RU"])
    kinds = [[(s.text, s.entity_type) for s in r.spans] for r in got]
    assert kinds == [[("ПРОЕКТ заря", "CUSTOM")], [], [], [("c@d.ru", "EMAIL")], [("проект (Заря", "CUSTOM"), ("проект заря", "CUSTOM")]]
    both = run(spark, ["число 1234567890 тут", "ИНН 7707083893"], deny=["1234567890", "7707083893"], allow=["1234567890", "7707083893"])
    assert [[(s.entity_type, s.confidence) for s in r.spans] for r in both] == [[("CUSTOM", 1.0)], [("CUSTOM", 1.0)]]
    keep = run(spark, ["ИНН 7707083893"], deny=["7707083893"])
    assert [(s.entity_type, s.source) for s in keep[0].spans] == [("INN", "pattern")]


@pytest.mark.parametrize("entries,words", [([""], "empty"), (["   "], "empty"), (["«»"], "empty"), (["x" * 201], "longer"), (["a"] * 501, "more than"), ([5], "not a string"), (["секрет", ""], "empty")])
def test_bad_entries(entries, words):
    with pytest.raises(InvalidListEntryError, match=words) as e:
        lists.validate_entries(entries, "deny_list")
    assert "секрет" not in str(e.value)


MORPH = Morphology({
    "проекта": (("проект",), "проект", (), True), "проект": (("проект",), "проект", (), True), "зари": (("заря",), "заря", (), True),
    "гусь": (("гусь",), "гусь", (), True), "иванова": (("иванов", "иванова"), "иванов", ("Surn",), True), "москвы": (("москва",), "москва", ("Geox",), True), "розы": (("роза",), "роза", (), True),
})


def test_morphology_lists(spark):
    assert [s.text for s in run(spark, ["для проекта «Зари» нет"], deny=["Проект Заря"], morph=MORPH)[0].spans] == ["проекта «Зари"]


def per(spark, rows, morph):
    df = spark.createDataFrame([(i, t, [(t.index(f), t.index(f) + len(f), "PER")]) for i, (t, f) in enumerate(rows)], "id long, text string, ner array<struct<start:int,end:int,entity_type:string>>")
    return [(r.spans[0].entity_type if r.spans else None) for r in detect(df, config=CONFIG, ner=ColumnNer("ner"), morph=morph).orderBy("id").collect()]


def test_context_layer(spark):
    rows = [("пришло письмо Надежды вчера", "Надежды"), ("пришла Ромашка вчера", "Ромашка"), ("сегодня была Рыба с овощами", "Рыба"), ("письмо от Иванова пришло", "Иванова")]
    assert per(spark, rows, Morphology()) == ["PER", None, "PER", "LOC"]
    rows = [("прилетел Гусь важный", "Гусь"), ("гражданин Гусь важный", "Гусь"), ("письмо от Иванова пришло", "Иванова"), ("едем из Москвы домой", "Москвы"), ("купил Розы вчера", "Розы")]
    assert per(spark, rows, MORPH) == [None, "PER", "PER", "LOC", None]


def test_ner_providers(spark):
    rows = spark.createDataFrame([(0, "живёт: ул. Ленина, д. 5, помещ. 7"), (1, None)], "id long, text string")
    got = detect(rows, config=CONFIG, ner=RuleNer()).orderBy("id").collect()
    assert [(s.text, s.confidence) for s in got[0].spans] == [("ул. Ленина", 0.75), ("д. 5", 0.6), ("помещ. 7", 0.6)]
    found = detect(rows, config=CONFIG, ner=PandasNer(lambda: lambda t: [(0, 5, "ORG")])).orderBy("id").collect()
    assert found[0].spans[0].entity_type == "ORG" and found[0].layer_stats == {"pattern": 0, "natasha": 1, "context": 1} and found[1].spans == []


def test_counts_explode_limits_and_clashes(spark):
    df = spark.createDataFrame([(1, "a@b.ru c@d.ru", 5), (2, "x" * 11, 6), (3, None, 7)], "id long, text string, spans long")
    out = detect(df, config=CONFIG)
    assert [tuple(r) for r in entity_counts(out, "id").collect()] == [(1, "EMAIL", 2)]
    assert exploded(out, "id").count() == 2 and out.filter("id = 3").first().spans == []
    fine, long = split_by_length(df, limit=12)
    assert fine.count() == 2 and long.count() == 1
    assert detect(df.limit(0), config=CONFIG).count() == 0


def test_detection_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a@b.ru")], "id long, text string")
    plan = detect(df, config=CONFIG, deny=["слово"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
