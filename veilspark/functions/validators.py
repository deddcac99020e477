"""Checksums and lookups as boolean columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from veilspark.functions import fixed as X, patterns as P


def digits(raw: Column) -> Column:
    """Only the digits of a string."""
    return F.regexp_replace(raw, r"(?U)\D", "")


def _digit_list(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.coalesce(F.substr(s, i, F.lit(1)).try_cast("int"), F.lit(0)))


def weighted(s: Column, weights: list[int]) -> Column:
    """Sum of digit times weight."""
    pairs = F.zip_with(_digit_list(s), F.array(*map(F.lit, weights)), lambda d, w: F.coalesce(d * w, F.lit(0)))
    return F.aggregate(pairs, F.lit(0), lambda a, b: a + b)


def _digit_at(s: Column, i: int) -> Column:
    return F.substring(s, i, 1).try_cast("int")


def luhn(s: Column) -> Column:
    """Luhn's check; a non-digit fails, nothing at all passes."""
    return (s == "") | F.coalesce(F.call_function("luhn_check", s), F.lit(False))


def ip(raw: Column) -> Column:
    return F.forall(F.split(raw, r"\."), lambda o: o.try_cast("int").between(0, 255))


def card(raw: Column) -> Column:
    """Spaces and hyphens go; any other separator fails."""
    bare = F.regexp_replace(raw, "[- ]", "")
    return (bare != "") & luhn(bare)


def inn(raw: Column) -> Column:
    s = F.trim(raw)
    ten = (weighted(s, X.INN_10) % 11 % 10) == _digit_at(s, 10)
    twelve = ((weighted(s, X.INN_12_FIRST) % 11 % 10) == _digit_at(s, 11)) & ((weighted(s, X.INN_12_SECOND) % 11 % 10) == _digit_at(s, 12))
    return F.when(s.rlike(r"^[0-9]{10}$"), ten).when(s.rlike(r"^[0-9]{12}$"), twelve).otherwise(False)


def snils(raw: Column) -> Column:
    s = digits(raw)
    check = weighted(F.substring(s, 1, 9), list(range(9, 0, -1))) % 101
    check = F.when(check == 100, 0).otherwise(check)
    good = (F.substring(s, 1, 9).try_cast("long") > X.SNILS_UNCHECKED_TO) & (check == F.substring(s, 10, 2).try_cast("int"))
    return F.when(F.length(s) == 11, F.coalesce(good, F.lit(False))).otherwise(False)


def ogrn(raw: Column) -> Column:
    s = digits(raw)
    def check(n: int, mod: int) -> Column:
        return F.coalesce((F.substring(s, 1, n - 1).try_cast("long") % mod % 10) == _digit_at(s, n), F.lit(False))
    return F.when(F.length(s) == 13, check(13, 11)).when(F.length(s) == 15, check(15, 13)).otherwise(False)


def passport(raw: Column) -> Column:
    return F.length(digits(raw)) == 10


def biks(context: Column) -> Column:
    """Bank codes that a label names."""
    return F.regexp_extract_all(context, F.lit(P.BIK), F.lit(1))


def account_key(account: Column, bik: Column) -> Column:
    """The 23-digit key of an account at a bank; correspondent accounts (301) use two digits of the code."""
    lead = F.when(F.startswith(account, F.lit("301")), F.concat(F.lit("0"), F.substring(bik, 5, 2))).otherwise(F.substring(bik, -3, 3))
    key = F.concat(lead, account)
    units = F.zip_with(_digit_list(key), F.array(*map(F.lit, X.ACCOUNT_WEIGHTS)), lambda d, w: F.coalesce(d * w, F.lit(0)) % 10)
    ok = account.rlike(r"^[0-9]{20}$") & bik.rlike(r"^04[0-9]{7}$")
    return ok & (F.aggregate(units, F.lit(0), lambda a, b: a + b) % 10 == 0)


def kpp(raw: Column) -> Column:
    shape = raw.rlike(r"(?U)^\d{4}[\s\S]{2}\d{3}$")
    return shape & F.substring(raw, 1, 2).isin(X.FNS_SUBJECT_CODES) & (F.substring(raw, 5, 2) != "00")


def car_plate(raw: Column) -> Column:
    return F.substring(F.regexp_replace(raw, r"(?U)\s", ""), 7, 9).isin(X.PLATE_REGION_CODES)


def parsed_date(raw: Column) -> Column:
    """The date of dd.mm.yyyy (also with / or -) or ``d month yyyy``; null if there is no such day."""
    numeric, named = r"(?U)^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", r"(?U)^(\d{1,2})\s+(\w+)\s+(\d{4})$"
    month = F.array_position(F.array(*map(F.lit, X.MONTHS_GENITIVE)), F.lower(F.regexp_extract(raw, named, 2)))
    def make(pattern: str, m: Column) -> Column:
        parts = [F.regexp_extract(raw, pattern, i).try_cast("int") for i in (3, 1)]
        text = F.format_string("%04d-%02d-%02d", parts[0], m.cast("int"), parts[1])
        return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.when(raw.rlike(numeric), make(numeric, F.regexp_extract(raw, numeric, 2).try_cast("int"))).when(raw.rlike(named) & (month > 0), make(named, month))


def birthdate(raw: Column, today: date) -> Column:
    """A date not after ``today`` and at most 120 years before it."""
    d, now = parsed_date(raw), F.lit(today)
    return F.coalesce((d <= now) & (d >= F.add_months(now, -1440)), F.lit(False))


def telegram(raw: Column) -> Column:
    name = F.regexp_replace(F.substring_index(raw, "/", -1), "^@+", "")
    return F.length(name).between(5, 32) & name.rlike("^[A-Za-z]")


#: National (area) codes of ten-digit Russian numbers that count as plausible.
_RU_CODES = "9[0-9]{2}|30[12]|34[1-35-79]|35[1-3]|365|38[1-58]|39[0145]|401|41[1356]|42[13467]|47[1-5]|48[1-7]|49[1-689]|80[0-49]|81[1-8]|82[01]|83[13-6]|84[0-8]|85[15]|86[0-35-79]|87[1-37-9]"


def phone(raw: Column) -> Column:
    """Plausibility of a phone number: Russian area codes, or the length of an international one.

    An approximation in place of a numbering-plan library (see the README).
    """
    s = digits(raw)
    ten = F.when((F.length(s) == 11) & s.rlike("^[78]"), F.substring(s, 2, 10)).when(F.length(s) == 10, s)
    russian = F.coalesce(ten.rlike(f"^(?:{_RU_CODES})"), F.lit(False))
    foreign = F.startswith(F.trim(raw), F.lit("+")) & ~F.startswith(s, F.lit("7")) & F.length(s).between(8, 15)
    return russian | foreign


def valid(kind: str, raw: Column, today: date) -> Column:
    """The check of an entity type; types without one pass."""
    checks = {
        "PHONE": phone, "IP": ip, "CARD": card, "INN": inn, "PASSPORT": passport, "KPP": kpp, "CAR_PLATE": car_plate,
        "TELEGRAM": telegram, "BIRTHDATE": lambda r: birthdate(r, today),
    }
    return checks[kind](raw) if kind in checks else F.lit(True)
