"""Checksums, lookups and dates."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from veilspark.functions import validators as V

TODAY = date(2026, 10, 3)
CASES = [
    ("INN", "7707083893", True), ("INN", "500100732259", True), ("INN", "1234567890", False), ("INN", "9161234568", False), ("INN", "77070838", False),
    ("SNILS", "112-233-445 95", True), ("SNILS", "11223344595", True), ("SNILS", "112 233 445 95", True), ("SNILS", "112-233-445 96", False), ("SNILS", "1122334459", False),
    ("SNILS", "002-008-999 00", True), ("SNILS", "002-009-899 00", True), ("SNILS", "001-001-998 00", False), ("SNILS", "000-000-001 00", False), ("SNILS", "001-001-999 65", True),
    ("OGRN", "1027700132195", True), ("OGRN", "304500116000157", True), ("OGRN", "1027700132196", False), ("OGRN", "304500116000158", False), ("OGRN", "102770013219", False),
    ("KPP", "771234234", True), ("KPP", "7712AB234", True), ("KPP", "771200234", False), ("KPP", "801234234", False), ("KPP", "77123423", False), ("KPP", "7712345A4", False),
    ("BIRTHDATE", "03.10.2026", True), ("BIRTHDATE", "04.10.2026", False), ("BIRTHDATE", "03.10.1906", True), ("BIRTHDATE", "02.10.1906", False),
    ("BIRTHDATE", "31.02.1990", False), ("BIRTHDATE", "5 марта 1990", True), ("BIRTHDATE", "29 февраля 2000", True), ("BIRTHDATE", "29 февраля 2001", False),
    ("IP", "255.0.0.001", True), ("IP", "256.1.1.1", False), ("CARD", "4111 1111 1111 1111", True), ("CARD", "4111-1111-1111-1111", True), ("CARD", "4111 1111 1111 1111", False), ("CARD", "4111111111111112", False),
    ("CAR_PLATE", "А123ВС77", True), ("CAR_PLATE", "К777ХН 799", True), ("CAR_PLATE", "А123ВС 00", False), ("PASSPORT", "45 10 123456", True), ("PASSPORT", "45 10 12345", False),
    ("TELEGRAM", "@ivan_petrov", True), ("TELEGRAM", "t.me/ivan", False), ("TELEGRAM", "https://t.me/ivan_petrov", True),
    ("PHONE", "+7 916 123-45-67", True), ("PHONE", "9161234568", True), ("PHONE", "(343) 312-00-32", True), ("PHONE", "+44 2079 460958", True), ("PHONE", "1234567890", False),
]


def test_table(spark):
    kinds = sorted({k for k, _, _ in CASES})
    df = spark.createDataFrame(CASES, "kind string, raw string, expected boolean")
    check = None
    for k in kinds:
        c = V.ogrn(F.col("raw")) if k == "OGRN" else V.snils(F.col("raw")) if k == "SNILS" else V.valid(k, F.col("raw"), TODAY)
        check = F.when(F.col("kind") == k, c) if check is None else check.when(F.col("kind") == k, c)
    bad = [(r.kind, r.raw, r.got) for r in df.withColumn("got", check).collect() if r.got != r.expected]
    assert not bad


@pytest.mark.parametrize("account,expected", [("40702810200000012345", True), ("40702810500000012345", False), ("30101810400000000225", True), ("4070281020000001234", False)])
def test_account_key(spark, account, expected):
    assert spark.range(1).select(V.account_key(F.lit(account), F.lit("044525225"))).first()[0] is expected


def test_biks_and_luhn(spark):
    r = spark.range(1).select(V.biks(F.lit("бик: 044525225, БИК 0445252251 БИК 041234567")).alias("b"), V.luhn(F.lit("")).alias("e"), V.luhn(F.lit("4a")).alias("x")).first()
    assert r.b == ["044525225", "041234567"] and r.e and not r.x
