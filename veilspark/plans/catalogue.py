"""Queries by operator, and SQL that computes the same without the engine.

Where documents hold too little of a kind, texts are made from table keys by expressions that
Spark SQL and DuckDB read alike (``_TEXTS``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.config import EngineConfig
from veilspark.functions import fixed as X, patterns as P, scoring, spans as S, validators as V
from veilspark.operators import audit, context, evaluate, lists, mask as M, pages
from veilspark.operators.detect import candidates, detect, entity_counts, exploded
from veilspark.operators.morphology import Morphology
from veilspark.operators.ner import ColumnNer
from veilspark.streaming import handles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TODAY = date(2026, 10, 3)
CONFIG = EngineConfig(today=TODAY)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.round(F.col(c), 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------------ scans of documents

# RE2 has no look-around: other characters are doubled, so that one can end a match and one begin the next.
_SCAN = """
WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM documents),
r AS (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m)
SELECT doc_id, (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0))::BIGINT AS start,
       (list_sum(list_transform(gs[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda g: length(g))))::BIGINT AS "end", ms[i] AS text FROM r
"""
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def _scan(spark, sf, kind):
    df = table(spark, sf, "documents").filter(F.col("text").rlike(P.PATTERNS[kind])).select("doc_id", F.explode(S.scan(F.col("text"), P.PATTERNS[kind])).alias("m"))
    return longs(df.select("doc_id", "m.start", "m.end", "m.text"))


@query(_SCAN.format(p=_EMAIL))
def scan_email_spans(spark, sf):
    return _scan(spark, sf, "EMAIL")


@query(r"""SELECT doc_id, ip AS text FROM (
  SELECT doc_id, replace(unnest(regexp_extract_all(regexp_replace(text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])([0-9]{1,3}\.\.[0-9]{1,3}\.\.[0-9]{1,3}\.\.[0-9]{1,3})(?:$|[^0-9])', 1)), '..', '.') AS ip FROM documents)""")
def scan_ipv4_spans(spark, sf):
    return _scan(spark, sf, "IP").select("doc_id", "text")


@query(r"""SELECT doc_id, ip AS text, 0.45::DOUBLE AS confidence FROM (
  SELECT doc_id, replace(unnest(regexp_extract_all(regexp_replace(text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])([0-9]{1,3}\.\.[0-9]{1,3}\.\.[0-9]{1,3}\.\.[0-9]{1,3})(?:$|[^0-9])', 1)), '..', '.') AS ip FROM documents)
WHERE list_max(list_transform(string_split(ip, '.'), lambda o: o::INT)) <= 255""")
def filter_ipv4_min_conf_045(spark, sf):
    df = table(spark, sf, "documents").filter(F.col("text").rlike(P.PATTERNS["IP"]))
    return df.select("doc_id", F.explode(candidates(F.col("text"), "IP", 0.45, TODAY)).alias("s")).select("doc_id", "s.text", "s.confidence")


_CARDS = r"""SELECT doc_id, regexp_replace(c, '[^0-9]', '', 'g') AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])([0-9]{4}(?:--|\s\s)?[0-9]{4}(?:--|\s\s)?[0-9]{4}(?:--|\s\s)?[0-9]{4})(?:$|[^0-9])', 1)) AS c FROM documents)"""
_LUHN = "list_sum(list_transform(range(0, length({n})), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse({n}), i + 1, 1)::INT WHEN substr(reverse({n}), i + 1, 1)::INT * 2 > 9 THEN substr(reverse({n}), i + 1, 1)::INT * 2 - 9 ELSE substr(reverse({n}), i + 1, 1)::INT * 2 END)) % 10 = 0"


@query(f"WITH c AS ({_CARDS}) SELECT doc_id, n AS card FROM c WHERE {_LUHN.format(n='n')}")
def scan_card_luhn(spark, sf):
    df = table(spark, sf, "documents").filter(F.col("text").rlike(P.PATTERNS["CARD"]))
    return df.select("doc_id", F.explode(candidates(F.col("text"), "CARD", 0.5, TODAY)).alias("s")).select("doc_id", V.digits(F.col("s.text")).alias("card"))


# ------------------------------------------------------------------ checks over numbers made from keys

def _keyed(name: str, raw: str, check, sql: str):
    """Numbers from order keys; both sides give (o_orderkey, raw, valid)."""

    def run(spark, sf):
        df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{raw} AS raw")
        return df.select("o_orderkey", "raw", check(F.col("raw")).alias("valid"))

    run.__name__ = name
    query(f"SELECT o_orderkey, raw, coalesce({sql}, false) AS valid FROM (SELECT o_orderkey, {raw} AS raw FROM orders)")(run)


def _wsum(weights) -> str:
    return "(" + " + ".join(f"substr(raw, {i + 1}, 1)::INT * {w}" for i, w in enumerate(weights)) + ")"


_NINE = "lpad(cast((o_orderkey * 7919 + 123456789) % 1000000000 as string), 9, '0')"
#: Fixed values, written out once more, so that SQL does not rest on the engine's tables.
_INN10, _INN12A, _INN12B = _wsum([2, 4, 10, 3, 5, 9, 4, 6, 8]), _wsum([7, 2, 4, 10, 3, 5, 9, 4, 6, 8]), _wsum([3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8])
_SUBJECTS = "(substr(raw, 1, 2) BETWEEN '01' AND '79' OR substr(raw, 1, 2) IN ('83', '86', '87', '89', '90', '91', '92', '93', '94', '95', '99'))"
_REGIONS = "({r} BETWEEN '01' AND '99' AND length({r}) = 2 OR {r} IN (" + ", ".join(f"'{c}'" for c in """101 102 103 105 109 111 113 115 116 118 121 122 123
124 125 126 131 133 134 136 138 142 147 150 152 154 155 156 158 159 161 163 164 166 172 173 174 177 178 180 181 184 185 186 190 193 196 197 198 199 224 250 252
323 550 702 716 750 761 763 774 777 778 790 797 799 977 997""".split()) + "))"
_keyed("checksum_inn10", f"concat({_NINE}, cast(o_custkey % 10 as string))", V.inn, f"{_INN10} % 11 % 10 = substr(raw, 10, 1)::INT")
_keyed("checksum_inn12", f"concat({_NINE}, '0', cast(o_custkey % 10 as string), cast(o_orderkey % 10 as string))", V.inn,
       f"{_INN12A} % 11 % 10 = substr(raw, 11, 1)::INT AND {_INN12B} % 11 % 10 = substr(raw, 12, 1)::INT")
_keyed("checksum_snils", "concat(lpad(cast((o_orderkey * 7919) % 1000000000 as string), 9, '0'), lpad(cast(o_custkey % 100 as string), 2, '0'))", V.snils,
       f"substr(raw, 1, 9)::BIGINT > 1001998 AND (CASE WHEN {_wsum(range(9, 0, -1))} % 101 = 100 THEN 0 ELSE {_wsum(range(9, 0, -1))} % 101 END) = substr(raw, 10, 2)::INT")
_keyed("checksum_ogrn", f"concat('102', {_NINE}, cast(o_custkey % 10 as string))", V.ogrn, "substr(raw, 1, 12)::BIGINT % 11 % 10 = substr(raw, 13, 1)::INT")
_keyed("checksum_ogrnip", f"concat('30450', {_NINE}, cast(o_custkey % 10 as string))", V.ogrn, "substr(raw, 1, 14)::BIGINT % 13 % 10 = substr(raw, 15, 1)::INT")
_keyed("checksum_luhn", f"concat('4000000', {_NINE})", V.card, _LUHN.format(n="raw"))
_keyed("validate_ip", "concat(cast(o_orderkey % 300 as string), '.', cast(o_custkey % 260 as string), '.0.1')", V.ip, "list_max(list_transform(string_split(raw, '.'), lambda o: o::INT)) <= 255")
_keyed("validate_passport", f"concat(substr({_NINE}, 1, 4 + cast(o_orderkey % 2 as int)), ' ', lpad(cast(o_custkey % 1000000 as string), 6, '0'))", V.passport, "length(regexp_replace(raw, '[^0-9]', '', 'g')) = 10")
_keyed("validate_kpp_region", f"concat({_NINE})", V.kpp, f"{_SUBJECTS} AND substr(raw, 5, 2) <> '00'")
_keyed("validate_plate_region", "concat('А123ВС ', cast(o_orderkey % 999 as string))", V.car_plate, _REGIONS.format(r="substr(replace(raw, ' ', ''), 7)"))
_keyed("validate_telegram", "concat('@', substr('1abcdef', 1 + cast(o_orderkey % 3 as int), 3 + cast(o_custkey % 4 as int)))", V.telegram, "length(raw) - 1 BETWEEN 5 AND 32 AND regexp_matches(substr(raw, 2, 1), '[A-Za-z]')")
_keyed("validate_birthdate", "concat(lpad(cast(1 + o_orderkey % 31 as string), 2, '0'), '.', lpad(cast(1 + o_custkey % 12 as string), 2, '0'), '.', cast(1900 + o_orderkey % 130 as string))", lambda r: V.birthdate(r, TODAY),
       "try_strptime(raw, '%d.%m.%Y')::DATE BETWEEN DATE '1906-10-03' AND DATE '2026-10-03'")
_keyed("bank_account_key", f"concat('40702810', cast(o_custkey % 10 as string), '00', {_NINE})", lambda r: V.account_key(r, F.lit("044525225")),
       "(" + " + ".join(f"(substr('225' || raw, {i + 1}, 1)::INT * {w}) % 10" for i, w in enumerate([7, 1, 3] * 7 + [7, 1])) + ") % 10 = 0")
_keyed("correspondent_account_key", f"concat('30101810', cast(o_custkey % 10 as string), '00', {_NINE})", lambda r: V.account_key(r, F.lit("044525225")),
       "(" + " + ".join(f"(substr('025' || raw, {i + 1}, 1)::INT * {w}) % 10" for i, w in enumerate([7, 1, 3] * 7 + [7, 1])) + ") % 10 = 0")


# ------------------------------------------------------------------ every pattern, over texts made from keys

def _found_in(kind: str, raw: str, ok: str = "true", leads=("поле ", "(", "7"), trails=(" конец", "\n")):
    """Spans of one type; SQL knows where the value lies.  After a last lead of ``7`` or ``_`` there is no match."""

    def run(spark, sf):
        df = table(spark, sf, "orders").selectExpr("o_orderkey", f"concat({lead}, {raw}, {trail}) AS text")
        df = df.select("o_orderkey", F.explode(candidates(F.col("text"), kind, 0.0, TODAY)).alias("s"))
        return longs(df.select("o_orderkey", "s.start", "s.end", "s.text", "s.entity_type"))

    lead = "CASE " + " ".join(f"WHEN o_orderkey % {len(leads)} = {i} THEN '{t}'" for i, t in enumerate(leads)) + " END"
    trail = "CASE " + " ".join(f"WHEN o_custkey % {len(trails)} = {i} THEN '{t}'" for i, t in enumerate(trails)) + " END"
    run.__name__ = f"spans_{kind.lower()}"
    query(f"""SELECT o_orderkey, length(lead)::BIGINT AS start, (length(lead) + length(raw))::BIGINT AS "end", raw AS text, '{kind}' AS entity_type
FROM (SELECT o_orderkey, o_custkey, {lead} AS lead, {raw} AS raw FROM orders) WHERE lead NOT IN ('7', '_') AND ({ok})""")(run)


_DIGIT, _CUST6, _TWO2 = "cast(o_custkey % 10 as string)", "lpad(cast(o_custkey % 1000000 as string), 6, '0')", "lpad(cast(o_orderkey % 100 as string), 2, '0')"
_found_in("PHONE", "concat('+7 (', CASE o_orderkey % 3 WHEN 0 THEN '916' WHEN 1 THEN '495' ELSE '101' END, ') ', substr(" + _NINE + ", 1, 3), '-', substr(" + _NINE + ", 4, 2), '-', substr(" + _NINE + ", 6, 2))",
          "substr(raw, 5, 3) <> '101'", leads=("тел ", "("))
_found_in("PASSPORT", f"concat('45 ', {_TWO2}, ' ', {_CUST6})")
_found_in("DRIVER_LICENSE", f"concat('77 ', CASE WHEN o_custkey % 2 = 0 THEN 'АВ' ELSE {_TWO2} END, ' ', {_CUST6})")
_found_in("INN", f"concat({_NINE}, {_DIGIT})", f"{_INN10} % 11 % 10 = substr(raw, 10, 1)::INT")
_found_in("SNILS", f"concat(substr({_NINE}, 1, 3), '-', substr({_NINE}, 4, 3), '-', substr({_NINE}, 7, 3), ' ', {_TWO2})")
_found_in("OGRN", f"concat('102', {_NINE}, {_DIGIT})")
_found_in("OGRNIP", f"concat('30450', {_NINE}, {_DIGIT})")
_found_in("KPP", _NINE, f"{_SUBJECTS} AND substr(raw, 5, 2) <> '00'")
_found_in("BANK_ACCOUNT", f"concat('40702810', {_DIGIT}, '00', {_NINE})")
_found_in("BIRTHDATE", "concat(lpad(cast(1 + o_orderkey % 31 as string), 2, '0'), CASE WHEN o_custkey % 2 = 0 THEN '.02.' ELSE ' мая ' END, cast(1900 + o_orderkey % 130 as string))",
          "try_strptime(replace(raw, ' мая ', '.05.'), '%d.%m.%Y')::DATE BETWEEN DATE '1906-10-03' AND DATE '2026-10-03'")
_found_in("TELEGRAM", "concat(CASE WHEN o_custkey % 3 = 0 THEN 't.me/' ELSE '@' END, substr('ivan_petrov', 1, 4 + cast(o_orderkey % 7 as int)))", "length(replace(raw, 't.me/', '@')) > 5", leads=("пишите ", "(", "_"))
_found_in("CAR_PLATE", "concat('А123ВС ', cast(o_orderkey % 999 as string))", _REGIONS.format(r="substr(replace(raw, ' ', ''), 7)"))
_found_in("CARD", f"concat('4000-000', substr({_NINE}, 1, 1), '-', substr({_NINE}, 2, 4), '-', substr({_NINE}, 6, 4))", _LUHN.format(n="replace(raw, '-', '')"))
_found_in("OMS", f"concat('4000000', {_NINE})")
_found_in("URL", "concat('http', CASE WHEN o_custkey % 2 = 0 THEN 's' ELSE '' END, '://a', cast(o_orderkey as string), '.example.ru/p?x=', cast(o_custkey as string))", leads=("см. ", "("))
_found_in("COORDS", f"concat('55.', {_CUST6}, CASE WHEN o_custkey % 2 = 0 THEN ', ' ELSE ' ' END, '-37.', {_TWO2})", leads=("точка ", "("))


_BIK_TEXT = "concat('банк, ', CASE o_orderkey % 3 WHEN 0 THEN 'БИК ' WHEN 1 THEN 'бик: ' ELSE 'код ' END, '04', lpad(cast(o_custkey % 10000000 as string), 7, '0'), CASE WHEN o_custkey % 4 = 0 THEN '5' ELSE '.' END)"


@query("SELECT o_orderkey, '04' || lpad(cast(o_custkey % 10000000 as string), 7, '0') AS bik FROM orders WHERE o_orderkey % 3 < 2 AND o_custkey % 4 > 0")
def find_biks(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_BIK_TEXT} AS text")
    return df.select("o_orderkey", F.explode(V.biks(F.col("text"))).alias("bik"))


# ------------------------------------------------------------------ scores over texts made from keys

def _scored(name: str, kind: str, raw: str, before: str, after: str, sql: str):
    def run(spark, sf):
        df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{raw} AS raw", f"{before} AS lead", f"{after} AS trail")
        text = F.concat("lead", "raw", "trail")
        start = F.length("lead")
        return df.select("o_orderkey", F.round(scoring.score(kind, text, F.col("raw"), start, start + F.length("raw")), 4).alias("score"))

    run.__name__ = name
    query(f"SELECT o_orderkey, round(greatest(0, least(1, {sql})), 4)::DOUBLE AS score FROM (SELECT o_orderkey, o_custkey, {raw} AS raw, {before} AS lead, {after} AS trail FROM orders)")(run)


def _choice(*texts: str, by: str = "o_orderkey") -> str:
    return "CASE " + " ".join(f"WHEN {by} % {len(texts)} = {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


_SIX = "lpad(cast(o_custkey % 1000000 as string), 6, '0')"
_TWO = "lpad(cast(o_orderkey % 100 as string), 2, '0')"
_ANTI = "CASE WHEN lead LIKE '%заказ%' OR trail LIKE ' руб%' THEN 0.4 ELSE 0 END"
_AFTER = _choice("", " руб.", " далее", by="o_custkey")
_scored("score_passport", "PASSPORT", f"concat('45 ', {_TWO}, ' ', {_SIX})", _choice("паспорт ", "заказ № ", "номер "), _AFTER,
        f"0.45 + CASE WHEN lead LIKE 'паспорт%' THEN 0.3 ELSE 0 END + CASE WHEN substr(raw, 4, 2)::INT <= 30 OR substr(raw, 4, 2)::INT >= 97 THEN 0.1 ELSE 0 END - {_ANTI}")
_SN = "concat(lpad(cast((o_orderkey * 7919) % 1000000000 as string), 9, '0'), lpad(cast(o_custkey % 100 as string), 2, '0'))"
_scored("score_snils", "SNILS", _SN, _choice("СНИЛС ", "заказ ", "номер "), _AFTER,
        "0.3 + CASE WHEN lead LIKE 'СНИЛС%' THEN 0.3 ELSE 0 END + CASE WHEN substr(raw, 1, 9)::BIGINT > 1001998 AND "
        f"(CASE WHEN {_wsum(range(9, 0, -1))} % 101 = 100 THEN 0 ELSE {_wsum(range(9, 0, -1))} % 101 END) = substr(raw, 10, 2)::INT THEN 0.4 ELSE 0 END - {_ANTI}")
_scored("score_ogrn", "OGRN", f"concat('102', {_NINE}, cast(o_custkey % 10 as string))", _choice("ОГРН ", "заказ ", "номер "), _AFTER,
        f"0.3 + CASE WHEN lead LIKE 'ОГРН%' THEN 0.3 ELSE 0 END + CASE WHEN substr(raw, 1, 12)::BIGINT % 11 % 10 = substr(raw, 13, 1)::INT THEN 0.4 ELSE 0 END - {_ANTI}")
_scored("score_kpp", "KPP", "'771234234'", _choice("КПП ", "КПП 1, БИК ", "номер ", "заказ КПП "), _AFTER,
        f"0.2 + CASE WHEN lead IN ('КПП ', 'заказ КПП ') THEN 0.45 ELSE 0 END - {_ANTI}")
_scored("score_plate", "CAR_PLATE", "'А123ВС77'", _choice("госномер ", "артикул ", "машина "), "''",
        "0.65 + CASE WHEN lead LIKE 'госномер%' THEN 0.2 ELSE 0 END - CASE WHEN lead LIKE 'артикул%' THEN 0.4 ELSE 0 END")
_scored("score_license", "DRIVER_LICENSE", _choice("99 01 123456", "9901123456", "77 ТТ 123456"), _choice("в/у ", "номер ", by="o_custkey"), "''",
        "0.3 + CASE WHEN lead = 'в/у ' THEN 0.4 ELSE 0 END + CASE WHEN raw <> '9901123456' THEN 0.15 ELSE 0 END")
_scored("score_oms", "OMS", f"concat('4000000', {_NINE})", _choice("полис ", "номер ", "заказ "), _AFTER,
        f"0.2 + CASE WHEN lead LIKE 'полис%' THEN 0.4 ELSE 0 END + CASE WHEN {_LUHN.format(n='raw')} THEN 0.25 ELSE 0 END - {_ANTI}")
_scored("score_birthdate", "BIRTHDATE", "'05.03.1990'", _choice("дата рождения ", "дата рождения 01.02.2003, ", "выдан ", "запись "), _choice("", " г.р.", by="o_custkey"),
        "0.2 + CASE WHEN lead = 'дата рождения ' OR trail = ' г.р.' THEN 0.5 ELSE 0 END - CASE WHEN lead = 'выдан ' THEN 0.4 ELSE 0 END")
_scored("score_telegram", "TELEGRAM", _choice("@ivan_petrov", "t.me/ivan_petrov"), _choice("tg: ", "пишите ", by="o_custkey"), "''",
        "CASE WHEN raw LIKE 't.me/%' THEN 0.8 WHEN lead = 'tg: ' THEN 0.6 ELSE 0.3 END")
_scored("score_account", "BANK_ACCOUNT", f"concat('407', cast(o_orderkey % 100 as string), {_choice('810', '811', by='o_custkey')}, lpad('', cast(14 - length(cast(o_orderkey % 100 as string)) as int), '7'))", _choice("счёт ", "номер ", "заказ "), "''",
        "0.3 + CASE WHEN lead = 'счёт ' THEN 0.25 ELSE 0 END + CASE WHEN substr(raw, 6, 3) IN ('810','643','840','978','156','392','826','756','398','933') THEN 0.4 ELSE 0 END - CASE WHEN lead = 'заказ ' THEN 0.4 ELSE 0 END")
_BIK_KEY = "(" + " + ".join(f"(substr('225' || raw, {i + 1}, 1)::INT * {w}) % 10" for i, w in enumerate([7, 1, 3] * 7 + [7, 1])) + ") % 10 = 0"
_scored("score_account_bik", "BANK_ACCOUNT", f"concat('40702811', cast(o_custkey % 10 as string), '00', {_NINE})", _choice("счёт ", "номер "), _choice(" БИК 044525225", ", далее", by="o_custkey"),
        f"0.3 + CASE WHEN lead = 'счёт ' THEN 0.25 ELSE 0 END + CASE WHEN trail LIKE ' БИК%' AND {_BIK_KEY} THEN 0.6 ELSE 0 END")
_scored("score_coords", "COORDS", _choice("55.751244, 37.618423", "55.75, 37.61", "95.1234, 37.6184", '55°45\'\'07" N 37°37\'\'04" E'), _choice("координаты ", "точка ", by="o_custkey"), "''",
        "CASE WHEN raw LIKE '%°%' THEN 0.7 ELSE 0.3 + CASE WHEN lead = 'координаты ' THEN 0.3 ELSE 0 END + CASE WHEN raw LIKE '55%' THEN 0.1 ELSE 0 END + CASE WHEN raw <> '55.75, 37.61' THEN 0.15 ELSE 0 END END")
_scored("score_ipv4", "IP", "'192.168.1.10'", _choice("ip ", "версия ", "адрес, версия ", "v", "клиент "), "''",
        "0.45 + CASE WHEN lead IN ('ip ', 'адрес, версия ') THEN 0.3 ELSE 0 END - CASE WHEN lead LIKE '%версия%' OR lead = 'v' THEN 0.4 ELSE 0 END")


# ------------------------------------------------------------------ span algebra over ranges made from lines

_LINES = """SELECT l_orderkey AS k, l_linenumber AS ord, (l_partkey * 7) % 60 AS s, (l_partkey * 7) % 60 + 1 + l_suppkey % 12 AS e, concat('T', cast(l_suppkey % 5 as string)) AS t FROM lineitem"""
_ISLANDS = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e DESC, ord, t) AS n FROM (""" + _LINES + """)),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM l),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR {apart} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS g FROM m)
"""


def _ranges(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("veil_lineitem")
    rows = spark.sql(_LINES.replace("FROM lineitem", "FROM veil_lineitem"))
    one = F.struct(F.col("ord").cast("int").alias("ord"), S.make(F.col("s"), F.col("e"), F.lit(""), F.col("t"), "pattern", 1.0).alias("x"))
    return rows.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(one)), lambda p: p.x).alias("spans"))


def _merged(spark, sf, prefer):
    got = _ranges(spark, sf).select("k", F.explode(S.merge(F.col("spans"), F.lit(""), prefer)).alias("x"))
    return longs(got.select("k", "x.start", "x.end", "x.entity_type"))


@query(_ISLANDS.format(apart="s >= pe") + 'SELECT k, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", arg_min(t, n) AS entity_type FROM i GROUP BY k, g')
def merge_spans_prefer_first(spark, sf):
    return _merged(spark, sf, S.first)


@query(_ISLANDS.format(apart="s >= pe") + 'SELECT k, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", arg_max(t, e * 100 - n) AS entity_type FROM i GROUP BY k, g')
def merge_spans_greater_end(spark, sf):
    return _merged(spark, sf, S.greater_end)


@query(_ISLANDS.format(apart="s > pe") + 'SELECT k, min(s)::BIGINT AS start, max(e)::BIGINT AS "end" FROM i GROUP BY k, g')
def union_intervals(spark, sf):
    return longs(_ranges(spark, sf).select("k", F.explode(S.union(F.col("spans"))).alias("x")).select("k", "x.start", "x.end"))


@query(_ISLANDS.format(apart="s > pe") + """, u AS (SELECT k, min(s) AS us, max(e) AS ue FROM i GROUP BY k, g)
SELECT k, sum(greatest(0, least(40, ue) - greatest(10, us)))::BIGINT AS chars FROM u GROUP BY k""")
def overlap_chars(spark, sf):
    return longs(_ranges(spark, sf).select("k", S.overlap(F.lit(10), F.lit(40), S.union(F.col("spans"))).alias("chars")))


@query(_ISLANDS.format(apart="s > pe") + """, u AS (SELECT k, min(s) AS us, max(e) AS ue FROM i GROUP BY k, g),
b AS (SELECT k, us, ue FROM u WHERE us < 70 AND ue > 5 UNION ALL SELECT DISTINCT k, 70, 70 FROM u),
g AS (SELECT k, greatest(5, coalesce(max(ue) OVER (PARTITION BY k ORDER BY us, ue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5)) AS start, least(70, us) AS fin FROM b)
SELECT k, start::BIGINT AS start, fin::BIGINT AS "end" FROM g WHERE start < fin""")
def subtract_intervals(spark, sf):
    span = S.make(F.lit(5), F.lit(70), F.lit(""), "PER", "natasha", 0.85)
    return longs(_ranges(spark, sf).select("k", F.explode(S.subtract(span, F.col("spans"), F.lit(""))).alias("x")).select("k", "x.start", "x.end"))


def _tie(name: str, a: str, b: str, ca: str, cb: str, sql: str):
    """Two spans of one range in either order."""

    def run(spark, sf):
        df = table(spark, sf, "orders").selectExpr("o_orderkey", f"cast({ca} as double) AS ca", f"cast({cb} as double) AS cb")
        x, y = S.make(F.lit(0), F.lit(9), F.lit(""), a, "pattern", F.col("ca")), S.make(F.lit(0), F.lit(9), F.lit(""), b, "pattern", F.col("cb"))
        both = F.when(F.col("o_orderkey") % 2 == 0, F.array(x, y)).otherwise(F.array(y, x))
        return df.select("o_orderkey", F.get(S.merge(both, F.lit("xxxxxxxxx"), S.by_evidence), F.lit(0)).entity_type.alias("entity_type"))

    run.__name__ = name
    query(f"SELECT o_orderkey, {sql} AS entity_type FROM (SELECT o_orderkey, {ca} AS ca, {cb} AS cb FROM orders)")(run)


_tie("tie_inn_passport", "PASSPORT", "INN", "0.7", "0.95", "'INN'")
_tie("tie_phone_inn", "PHONE", "INN", "0.95", "0.95", "'INN'")
_tie("tie_license_passport", "PASSPORT", "DRIVER_LICENSE", "(o_custkey % 3) / 10.0", "(o_custkey % 2) / 10.0", "CASE WHEN cb > ca THEN 'DRIVER_LICENSE' ELSE 'PASSPORT' END")
_tie("tie_card_oms", "CARD", "OMS", "0.95", "(75 + o_custkey % 10) / 100.0", "CASE WHEN cb >= 0.8 THEN 'OMS' ELSE 'CARD' END")
_tie("tie_url_telegram", "URL", "TELEGRAM", "0.95", "0.8", "'TELEGRAM'")


# ------------------------------------------------------------------ context and lists

def _names(spark, sf, lead: str, word: str):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{lead} AS lead", f"{word} AS word")
    text = F.concat("lead", "word", F.lit(" вчера"))
    span = F.struct(F.length("lead").alias("start"), (F.length("lead") + F.length("word")).alias("end"), F.lit("PER").alias("entity_type"))
    df = df.select("o_orderkey", text.alias("text"), F.array(span).alias("ner"))
    out = detect(df, config=CONFIG, ner=ColumnNer("ner"))
    return out.select("o_orderkey", F.size("spans").cast("long").alias("n"), F.get("spans", F.lit(0)).entity_type.alias("entity_type"))


_LEAD, _WORD = _choice("пришло письмо от ", "сегодня была ", "живёт там у ", "клиент "), _choice("Ромашка", "Иванова", "Рыба", "Май", "Анна Петрова", by="o_custkey")


@query(f"""WITH t AS (SELECT o_orderkey, {_LEAD} AS lead, {_WORD} AS word FROM orders)
SELECT o_orderkey, CASE WHEN word IN ('Ромашка', 'Май') THEN 0 ELSE 1 END::BIGINT AS n,
  CASE WHEN word IN ('Ромашка', 'Май') THEN NULL WHEN lead IN ('пришло письмо от ', 'живёт там у ') THEN 'LOC' ELSE 'PER' END AS entity_type FROM t""")
def resolve_per_loc(spark, sf):
    return _names(spark, sf, _LEAD, _WORD)


@query(f"SELECT o_orderkey, word, word IN ('Ромашка', 'Май') AS listed FROM (SELECT o_orderkey, {_WORD} AS word FROM orders)")
def whitelist_filter(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_WORD} AS word")
    span = F.struct(F.lit(0).alias("start"), F.length("word").alias("end"), F.col("word").alias("text"))
    return df.select("o_orderkey", "word", context.is_false_person(span, F.col("word"), Morphology()).alias("listed"))


@query(f"""SELECT o_orderkey, lead LIKE 'клиент%' AS kept FROM (SELECT o_orderkey, {_LEAD} AS lead FROM orders)""")
def person_marker_filter(spark, sf):
    morph = Morphology({"гусь": (("гусь",), "гусь", (), True)})
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_LEAD} AS lead")
    text = F.concat("lead", F.lit("Гусь пришёл"))
    span = F.struct(F.length("lead").alias("start"), (F.length("lead") + 4).alias("end"), F.lit("Гусь").alias("text"))
    return df.select("o_orderkey", (~context.is_false_person(span, text, morph)).alias("kept"))


_ORGS = _choice("ООО Ромашка", "ромашка", "Ромашки", "ИНН 7707083893", "«Заря»", by="o_custkey")


@query(f"SELECT o_orderkey, value, value NOT IN ('ООО Ромашка', 'ромашка', 'ИНН 7707083893') AS kept FROM (SELECT o_orderkey, {_ORGS} AS value FROM orders)")
def allow_list_anti_join(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_ORGS} AS value")
    span = F.array(S.make(F.lit(0), F.length("value"), F.col("value"), "ORG", "natasha", 0.85))
    return df.select("o_orderkey", "value", (F.size(lists.drop_allowed(span, ["Ромашка", "7707083893"], Morphology())) == 1).alias("kept"))


_PROJECT = _choice("идёт ПРОЕКТ заря сейчас", "идёт проекта Заря", "проект, «Заря» и проект", "просто заря", "Проект: заря", by="o_custkey")


@query(f"""SELECT o_orderkey, CASE WHEN value LIKE 'идёт ПРОЕКТ%' THEN 5 WHEN value LIKE 'проект,%' THEN 0 END::BIGINT AS start,
  CASE WHEN value LIKE 'идёт ПРОЕКТ%' THEN 16 WHEN value LIKE 'проект,%' THEN 13 END::BIGINT AS "end"
FROM (SELECT o_orderkey, {_PROJECT} AS value FROM orders) WHERE value LIKE 'идёт ПРОЕКТ%' OR value LIKE 'проект,%'""")
def deny_list_ngram(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_PROJECT} AS value")
    return longs(df.select("o_orderkey", F.explode(lists.deny_spans(F.col("value"), ["Проект Заря"], Morphology())).alias("s")).select("o_orderkey", "s.start", "s.end"))


@query("SELECT o_orderkey, 'CUSTOM' AS entity_type, '7707083893' AS text FROM orders")
def deny_over_allow(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.lit("ИНН 7707083893").alias("text"))
    out = detect(df, config=CONFIG, allow=["7707083893"], deny=["7707083893"], kinds=["INN"])
    return exploded(out, "o_orderkey").select("o_orderkey", "entity_type", "text")


# ------------------------------------------------------------------ masking

_TOKEN = "'<' || {k} || '_' || upper(substr(sha256({k} || ':' || {n}), 1, 8)) || '>'"


@query(f"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS ms FROM documents)
SELECT doc_id, sha256(list_reduce(list_prepend(text, list_distinct(ms)), lambda a, e: replace(a, e, {_TOKEN.format(k="'EMAIL'", n="lower(e)")}))) AS masked_sha256, len(ms)::BIGINT AS n FROM m""")
def mask_documents(spark, sf):
    df = detect(table(spark, sf, "documents").select("doc_id", "text"), config=CONFIG, kinds=["EMAIL"])
    return df.select("doc_id", F.sha2(M.masked_text(F.col("text"), F.col("spans")), 256).alias("masked_sha256"), F.size("spans").cast("long").alias("n"))


_VALUES = "CASE WHEN o_orderkey % 2 = 0 THEN concat('  «Иван ', cast(o_custkey as string), '»!') ELSE concat('иван   ', cast(o_custkey as string)) END"


@query(f"SELECT o_orderkey, {_TOKEN.format(k=chr(39) + 'PER' + chr(39), n='v')} AS token FROM (SELECT o_orderkey, 'иван ' || o_custkey AS v FROM orders)")
def token_for_value(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_VALUES} AS v")
    return df.select("o_orderkey", M.token(F.lit("PER"), F.col("v")).alias("token"))


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 5 <= 1 THEN 'ромашка' WHEN o_custkey % 5 = 2 THEN 'ромашки' WHEN o_custkey % 5 = 3 THEN 'инн 7707083893' ELSE 'заря' END AS norm FROM orders")
def normalize_org(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_ORGS} AS value")
    return df.select("o_orderkey", M.normalized(F.lit("ORG"), F.col("value")).alias("norm"))


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS e, text FROM documents),
r AS (SELECT doc_id, e, instr(text, e) AS p, {_TOKEN.format(k="'EMAIL'", n="lower(e)")} AS token FROM m)
SELECT doc_id, token, arg_min(e, p) AS original, 'EMAIL' AS entity_type, count(*)::BIGINT AS mentions FROM r GROUP BY doc_id, token""")
def mapping_table(spark, sf):
    df = detect(table(spark, sf, "documents").select("doc_id", "text"), config=CONFIG, kinds=["EMAIL"])
    return M.mapping_table(df, "doc_id").select("doc_id", "token", "original", "entity_type", "mentions")


@query("SELECT doc_id, sha256(text) AS restored_sha256 FROM documents")
def demask_roundtrip(spark, sf):
    df = M.demask(M.mask(detect(table(spark, sf, "documents").select("doc_id", "text"), config=CONFIG, kinds=["EMAIL"])))
    return df.select("doc_id", F.sha2("restored_text", 256).alias("restored_sha256"))


# ------------------------------------------------------------------ counts and audit

_FOUND = f"""WITH c AS ({_CARDS}), found AS (
  SELECT doc_id, 'CARD' AS entity_type FROM c WHERE {_LUHN.format(n='n')}
  UNION ALL SELECT doc_id, 'EMAIL' FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS e FROM documents))
"""
_KINDS = ["EMAIL", "CARD"]


def _found(spark, sf, *cols):
    return detect(table(spark, sf, "documents").select("doc_id", "text", *cols), config=CONFIG, kinds=_KINDS)


@query(_FOUND + "SELECT entity_type, count(*)::BIGINT AS n FROM found GROUP BY entity_type")
def entity_counts_by_type(spark, sf):
    return entity_counts(_found(spark, sf))


@query(_FOUND + "SELECT lang, source, entity_type, count(*)::BIGINT AS n FROM found JOIN documents USING (doc_id) GROUP BY ALL")
def entity_counts_by_lang_source(spark, sf):
    return entity_counts(_found(spark, sf, "lang", "source"), "lang", "source")


@query(_FOUND + """, n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_pattern, 0::BIGINT AS n_ner, coalesce(n, 0)::BIGINT AS n_context FROM documents LEFT JOIN n USING (doc_id)""")
def layer_stats(spark, sf):
    s = F.col("layer_stats")
    return longs(_found(spark, sf).select("doc_id", s["pattern"].alias("n_pattern"), s["natasha"].alias("n_ner"), s["context"].alias("n_context")))


@query(_FOUND + """SELECT count(*)::BIGINT AS total_entities, count(*) FILTER (WHERE entity_type = 'EMAIL')::BIGINT AS n_email, count(*) FILTER (WHERE entity_type = 'CARD')::BIGINT AS n_card,
  (SELECT count(DISTINCT doc_id) FROM found)::BIGINT AS llm_requests, 0::BIGINT AS llm_failed FROM found""")
def session_stats(spark, sf):
    found = M.mask(_found(spark, sf))
    asked = found.filter(F.size("spans") > 0).select("masked_text", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    got = audit.session_stats(audit.detection_events(found, at=None), audit.llm_events(asked))
    m = F.col("entity_counts")
    return longs(got.select("total_entities", F.coalesce(m["EMAIL"], F.lit(0)).alias("n_email"), F.coalesce(m["CARD"], F.lit(0)).alias("n_card"), "llm_requests", "llm_failed"))


@query()
def detect_full_pipeline(spark, sf):
    """All 18 types over whole texts, masked and restored."""
    df = M.demask(M.mask(detect(table(spark, sf, "documents").select("doc_id", "text", "lang"), config=CONFIG)))
    return df.select("doc_id", "lang", "masked_text", F.size("spans").cast("long").alias("n_spans"), F.size("mapping").cast("long").alias("n_tokens"), (F.col("restored_text") == F.col("text")).alias("restored"))


@query()
def detect_all_types(spark, sf):
    out = detect(table(spark, sf, "documents").select("doc_id", "text"), config=CONFIG, min_confidence=0.4)
    return longs(exploded(out, "doc_id").select("doc_id", "start", "end", "entity_type", "confidence"))


# ------------------------------------------------------------------ pages

_WORDS = """SELECT cast(o_orderkey % 50 as string) AS doc, cast(o_custkey % 3 as int) AS page, cast(o_orderkey % 4 as int) AS block_no,
  cast(o_custkey % 7 as int) AS line_no, cast(o_orderkey as int) AS word_no, concat('w', cast(o_orderkey as string), CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '' END) AS text,
  cast(o_orderkey % 100 as double) AS x0, cast(o_custkey % 100 as double) AS y0, cast(o_orderkey % 100 + 8 as double) AS x1, cast(o_custkey % 100 + 4 as double) AS y1 FROM orders"""
_PAGE_TEXT = "WITH w AS (" + _WORDS + """), o AS (SELECT *, lead(line_no) OVER p AS nl, row_number() OVER p AS n FROM w WINDOW p AS (PARTITION BY doc, page, block_no ORDER BY line_no, word_no)),
j AS (SELECT doc, page, block_no, n, CASE WHEN nl IS NULL THEN text WHEN nl = line_no THEN text || ' ' WHEN text LIKE '_%-' THEN substr(text, 1, length(text) - 1) ELSE text || chr(10) END AS piece,
  CASE WHEN nl IS NOT NULL AND nl <> line_no AND text LIKE '_%-' THEN 1 ELSE 0 END AS wrapped, length(text) AS len FROM o)
"""


def _words(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("veil_orders")
    return spark.sql(_WORDS.replace("FROM orders", "FROM veil_orders"))


@query(_PAGE_TEXT + "SELECT doc, page::BIGINT AS page, block_no::BIGINT AS block_no, sha256(string_agg(piece, '' ORDER BY n)) AS text_sha256, count(*)::BIGINT AS n_words FROM j GROUP BY doc, page, block_no")
def page_block_join(spark, sf):
    b = pages.blocks(pages.page_words(_words(spark, sf)))
    return longs(b.select("doc", "page", "block_no", F.sha2("text", 256).alias("text_sha256"), F.size("words").alias("n_words")))


@query(_PAGE_TEXT + "SELECT doc, page::BIGINT AS page, block_no::BIGINT AS block_no, sum(wrapped)::BIGINT AS n_wrapped FROM j GROUP BY doc, page, block_no")
def page_hyphen_join(spark, sf):
    w = pages.page_words(_words(spark, sf))
    full = w.groupBy(*pages.KEYS).agg(F.sum(F.length("text")).alias("all"))
    b = pages.blocks(w).select(*pages.KEYS, F.aggregate(F.transform("words", lambda x: F.length(x.text)), F.lit(0), lambda a, x: a + x).alias("left"))
    return longs(full.join(b, list(pages.KEYS)).select("doc", "page", "block_no", (F.col("all") - F.col("left")).alias("n_wrapped")))


_MAIL = "CASE WHEN o_orderkey % 10 = 0 THEN concat('u', cast(o_orderkey as string), '@ex.org') ELSE concat('w', cast(o_orderkey as string)) END"
_MAIL_WORDS = _WORDS.replace("concat('w', cast(o_orderkey as string), CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '' END)", _MAIL)


def _mail_blocks(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("veil_orders")
    w = spark.sql(_MAIL_WORDS.replace("FROM orders", "FROM veil_orders"))
    return detect(pages.blocks(pages.page_words(w)), config=CONFIG, kinds=["EMAIL"])


@query(f"SELECT doc, page::BIGINT AS page, 'EMAIL' AS entity_type, count(*)::BIGINT AS n FROM ({_MAIL_WORDS}) WHERE text LIKE '%@%' GROUP BY doc, page")
def page_entity_counts(spark, sf):
    return longs(pages.entity_counts(_mail_blocks(spark, sf)))


@query(f"SELECT doc, page::BIGINT AS page, block_no::BIGINT AS block_no, text FROM ({_MAIL_WORDS}) WHERE text LIKE '%@%'")
def words_in_spans(spark, sf):
    m = pages.matched_words(_mail_blocks(spark, sf))
    return longs(m.select("doc", "page", "block_no", F.explode("words").alias("w")).filter("w.matched").select("doc", "page", "block_no", "w.text"))


@query(f"SELECT doc, page::BIGINT AS page, text, x0 - 2 AS x0, y0 - 2 AS y0, x1 + 2 AS x1, y1 + 2 AS y1 FROM ({_MAIL_WORDS}) WHERE text LIKE '%@%'")
def redaction_boxes(spark, sf):
    boxes = pages.redaction_boxes(pages.matched_words(_mail_blocks(spark, sf)))
    return longs(boxes.select("doc", "page", "text", "x0", "y0", "x1", "y1"))


@query(f"SELECT doc, 3::BIGINT AS pages_processed, count(*) FILTER (WHERE text LIKE '%@%')::BIGINT AS total FROM ({_MAIL_WORDS}) GROUP BY doc")
def page_redaction_summary(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("veil_orders")
    w = pages.page_words(spark.sql(_MAIL_WORDS.replace("FROM orders", "FROM veil_orders")))
    s = pages.redact(w, config=CONFIG, kinds=["EMAIL"])[1]
    return longs(s.select("doc", "pages_processed", F.col("total_spans_redacted").alias("total")))


@query(f"""WITH w AS ({_WORDS}), layer AS (SELECT * FROM w WHERE word_no % 2 = 0), ocr AS (SELECT * FROM w WHERE word_no % 2 = 1)
SELECT o.doc, o.page::BIGINT AS page, o.word_no::BIGINT AS word_no FROM ocr o WHERE NOT EXISTS (SELECT 1 FROM layer b WHERE b.doc = o.doc AND b.page = o.page
  AND (o.x0 + o.x1) / 2 BETWEEN b.x0 AND b.x1 AND (o.y0 + o.y1) / 2 BETWEEN b.y0 AND b.y1)""")
def ocr_center_exclusion(spark, sf):
    w = _words(spark, sf)
    return longs(pages.without_covered(w.filter("word_no % 2 = 1"), w.filter("word_no % 2 = 0")).select("doc", "page", "word_no"))


@query(f"""WITH w AS ({_WORDS}), r AS (SELECT doc, page, word_no AS run_no, x0, y0, x1, y1 FROM w WHERE word_no % 3 = 0)
SELECT w.doc, w.page::BIGINT AS page, w.word_no::BIGINT AS word_no, min(r.run_no)::BIGINT AS run_no FROM w LEFT JOIN r ON w.doc = r.doc AND w.page = r.page
  AND (w.x0 + w.x1) / 2 BETWEEN r.x0 - 1 AND r.x1 + 1 AND (w.y0 + w.y1) / 2 BETWEEN r.y0 - 1 AND r.y1 + 1 GROUP BY w.doc, w.page, w.block_no, w.line_no, w.word_no""")
def font_run_of_word(spark, sf):
    w = _words(spark, sf)
    runs = w.filter("word_no % 3 = 0").select("doc", "page", F.col("word_no").alias("run_no"), F.lit("ABCDEF+Arial").alias("font"), F.lit(9.0).alias("size"), F.lit(0xFF8000).alias("color"), "x0", "y0", "x1", "y1")
    return longs(pages.font_run_of_word(w, runs).select("doc", "page", "word_no", "run_no"))


# ------------------------------------------------------------------ evaluation over gold and predicted ranges made from lines

_GOLD = "SELECT l_orderkey AS id, l_linenumber AS ord, (l_partkey * 7) % 90 AS s, (l_partkey * 7) % 90 + 5 AS e, CASE WHEN l_suppkey % 4 = 0 THEN 'NAME' WHEN l_suppkey % 4 = 1 THEN 'EMAIL' WHEN l_suppkey % 4 = 2 THEN 'CVC' ELSE 'INN' END AS t FROM lineitem WHERE l_linenumber % 2 = 1 AND l_orderkey % 7 <> 0"
_PRED = "SELECT l_orderkey AS id, l_linenumber AS ord, (l_partkey * 7) % 90 AS s, (l_partkey * 7) % 90 + 5 + l_suppkey % 2 * 3 AS e, CASE WHEN l_suppkey % 4 = 0 THEN 'PER' WHEN l_suppkey % 4 = 1 THEN 'EMAIL' ELSE 'INN' END AS t FROM lineitem WHERE l_linenumber % 3 <> 0"
_EVAL = f"""WITH gold AS ({_GOLD}), pred AS ({_PRED}),
ex AS (SELECT o_orderkey AS id, o_orderpriority AS domain FROM orders),
gc AS (SELECT DISTINCT id, unnest(range(s, e)) AS c FROM gold), pc AS (SELECT DISTINCT id, unnest(range(s, e)) AS c FROM pred),
tm AS (SELECT * FROM (VALUES ('NAME', 'PER'), ('EMAIL', 'EMAIL'), ('INN', 'INN')) v(t, want)),
g1 AS (SELECT g.id, g.ord, g.s, g.e, g.t, tm.want,
         (SELECT count(*) FROM pc WHERE pc.id = g.id AND pc.c >= g.s AND pc.c < g.e) AS covered,
         (SELECT count(*) FROM pred p WHERE p.id = g.id AND p.s = g.s AND p.e = g.e AND p.t = tm.want) > 0 AS strict,
         (SELECT min({{'n': greatest(g.s, p.s) - least(g.e, p.e), 'o': p.ord, 's': p.s, 'e': p.e, 't': p.t}}).t FROM pred p WHERE p.id = g.id AND least(g.e, p.e) > greatest(g.s, p.s)) AS best
       FROM gold g LEFT JOIN tm ON tm.t = g.t),
p1 AS (SELECT p.id, p.ord, p.s, p.e, p.t,
         p.e - p.s - (SELECT count(*) FROM gc WHERE gc.id = p.id AND gc.c >= p.s AND gc.c < p.e) AS fp,
         (SELECT count(*) FROM gold g WHERE g.id = p.id AND least(g.e, p.e) > greatest(g.s, p.s)) > 0 AS relaxed,
         (SELECT count(*) FROM gold g JOIN tm ON tm.t = g.t WHERE g.id = p.id AND g.s = p.s AND g.e = p.e AND tm.want = p.t) > 0 AS strict
       FROM pred p),
facts AS (
  SELECT domain, NULL AS t, NULL AS grp, NULL AS k, 1 AS examples, 0 AS gold_entities, 0 AS gold_chars, 0 AS covered_chars, 0 AS strict_hits, 0 AS relaxed_hits, 0 AS type_evaluated, 0 AS type_correct,
         0 AS pred_spans, 0 AS pred_chars, 0 AS fp_chars, 0 AS strict_pred_hits, 0 AS relaxed_pred_hits,
         (NOT EXISTS (SELECT 1 FROM gold g WHERE g.id = ex.id))::INT AS clean_examples,
         (NOT EXISTS (SELECT 1 FROM gold g WHERE g.id = ex.id) AND EXISTS (SELECT 1 FROM pred p WHERE p.id = ex.id))::INT AS clean_examples_with_fp,
         CASE WHEN NOT EXISTS (SELECT 1 FROM gold g WHERE g.id = ex.id) THEN (SELECT count(*) FROM pred p WHERE p.id = ex.id) ELSE 0 END AS fp_spans_on_clean FROM ex
  UNION ALL SELECT domain, t, CASE WHEN t = 'CVC' THEN 'unsupported' ELSE 'supported' END, NULL, 0, 1, e - s, covered, strict::INT, (best IS NOT NULL)::INT, (best IS NOT NULL AND want IS NOT NULL)::INT, coalesce(best = want, false)::INT,
         0, 0, 0, 0, 0, 0, 0, 0 FROM g1 JOIN ex USING (id)
  UNION ALL SELECT domain, NULL, NULL, t, 0, 0, 0, 0, 0, 0, 0, 0, 1, e - s, fp, strict::INT, relaxed::INT, 0, 0, 0 FROM p1 JOIN ex USING (id))
"""
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in evaluate.COUNTERS)


def _examples(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("veil_lineitem")

    def side(sql: str, kind: str, out: str) -> DataFrame:
        df = spark.sql(sql.replace("FROM lineitem", "FROM veil_lineitem"))
        one = F.struct(F.col("ord"), F.struct(F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), F.col("t").alias(kind)).alias("x"))
        return df.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda p: p.x).alias(out))

    ex = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"))
    return ex.join(side(_GOLD, "type", "entities"), "id", "left").join(side(_PRED, "entity_type", "pred"), "id", "left")


def _section(spark, sf, section):
    return evaluate.counters(_examples(spark, sf)).filter(F.col("section") == section).select("key", *evaluate.COUNTERS)


@query(_EVAL + f"SELECT 'all' AS key, {_SUMS} FROM facts")
def eval_counts_overall(spark, sf):
    return _section(spark, sf, "overall")


@query(_EVAL + f"SELECT domain AS key, {_SUMS} FROM facts GROUP BY domain")
def eval_by_domain(spark, sf):
    return _section(spark, sf, "by_domain")


@query(_EVAL + f"SELECT t AS key, {_SUMS} FROM facts WHERE t IS NOT NULL GROUP BY t")
def eval_by_type(spark, sf):
    return _section(spark, sf, "by_type")


@query(_EVAL + f"SELECT grp AS key, {_SUMS} FROM facts WHERE grp IS NOT NULL GROUP BY grp")
def eval_by_group(spark, sf):
    return _section(spark, sf, "by_group")


@query(_EVAL + f"SELECT k AS key, {_SUMS} FROM facts WHERE k IS NOT NULL GROUP BY k")
def eval_by_pred_type(spark, sf):
    return _section(spark, sf, "by_pred_type")


@query(_EVAL + f", c AS (SELECT domain AS key, {_SUMS} FROM facts GROUP BY domain) SELECT key, " + ", ".join(f"round({n}::DOUBLE / nullif({d}, 0), 4) AS {r}" for r, (n, d, _) in evaluate.RATES.items()) + " FROM c")
def eval_rates(spark, sf):
    got = evaluate.with_rates(evaluate.counters(_examples(spark, sf)).filter("section = 'by_domain'"))
    return longs(got.select("key", *evaluate.RATES))


@query(_EVAL + 'SELECT id, t AS type, s::BIGINT AS start, e::BIGINT AS "end" FROM g1 WHERE best IS NULL')
def eval_misses(spark, sf):
    return longs(evaluate.misses(_examples(spark, sf)))


@query("""WITH b AS (SELECT o_orderpriority AS key, count(*) FILTER (WHERE o_orderkey % 3 = 0) / count(*)::DOUBLE AS before, count(*) FILTER (WHERE o_orderkey % 2 = 0) / count(*)::DOUBLE AS after FROM orders GROUP BY 1)
SELECT 'by_domain' AS section, key, m AS metric, round(before, 4) AS before, round(after, 4) AS after, round(after - before, 4) AS delta,
  CASE WHEN abs(after - before) < 1e-9 THEN '' WHEN (after > before) = (m <> 'fp_char_rate') THEN 'better' ELSE 'worse' END AS verdict
FROM b, (VALUES ('leak_recall'), ('fp_char_rate')) v(m)""")
def eval_compare(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg((F.count_if(F.col("o_orderkey") % 3 == 0) / F.count("*")).alias("b"), (F.count_if(F.col("o_orderkey") % 2 == 0) / F.count("*")).alias("a"))
    side = lambda c: o.select(F.lit("by_domain").alias("section"), "key", F.explode(F.array(F.lit("leak_recall"), F.lit("fp_char_rate"))).alias("metric"), F.col(c).alias("rate"), F.lit("").alias("detail"))
    return longs(evaluate.compare(side("b"), side("a")).select("section", "key", "metric", "before", "after", "delta", "verdict"))


# ------------------------------------------------------------------ handles and streams

@query("""SELECT event_id, (date_diff('microsecond', ts, TIMESTAMP '2030-01-01 00:00:00') / 1000000.0 >= 300) AS expired FROM events""")
def handle_expiry(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"))
    now = "2030-01-01 00:00:00"
    gone = handles.swept(e, now).select("event_id", F.lit(True).alias("expired"))
    return gone.unionByName(handles.live(e, now).select("event_id", F.lit(False).alias("expired")))


_EVENTS = "SELECT cast(user_id as string) AS handle, ts, CASE WHEN event_id % 2 = 0 THEN 'register' ELSE 'pop' END AS op, cast(event_id as string) AS payload FROM events"


@query(f"""WITH e AS (SELECT *, lag(op) OVER w AS lop, lag(ts) OVER w AS lts, lag(payload) OVER w AS lp FROM ({_EVENTS}) WINDOW w AS (PARTITION BY handle ORDER BY ts, CASE WHEN op = 'register' THEN 0 ELSE 1 END)),
r AS (SELECT handle, ts, op, lp, coalesce(lop = 'register' AND date_diff('microsecond', lts, ts) / 1000000.0 < 86400, false) AS ok FROM e)
SELECT op, CASE WHEN op = 'register' THEN 'registered' WHEN ok THEN 'popped' ELSE 'unknown' END AS outcome, count(*)::BIGINT AS n FROM r GROUP BY 1, 2""")
def handle_single_use(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("veil_events")
    e = spark.sql(_EVENTS.replace("FROM events", "FROM veil_events"))
    return handles.resolve(e, 86400).groupBy("op", "outcome").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def audit_counts_windowed(spark, sf):
    return handles.windowed_counts(table(spark, sf, "events"))
