"""Confidence of a match from its form and its surroundings.

A scorer is data: a base, a list of (condition, points), and whether order or price markers
nearby count against it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from veilspark.functions import fixed as X, patterns as P, validators as V


@dataclass(frozen=True)
class Spot:
    """A match and the text around it."""

    raw: Column
    before: Column
    after: Column

    def near(self, words: str) -> Column:
        """A marker before or after, never across the match."""
        return self.before.rlike(words) | self.after.rlike(words)


def context(text: Column, start: Column, end: Column, before: int = X.WINDOW_BEFORE, after: int = X.WINDOW_AFTER, lines: bool = False) -> tuple[Column, Column]:
    """Up to so many characters on either side; only of the same line unless ``lines``."""
    size = F.least(start, F.lit(before))
    left = F.substr(text, start - size + 1, size)
    right = F.substr(text, end + 1, F.lit(after))
    return (left, right) if lines else (F.substring_index(left, "\n", -1), F.substring_index(right, "\n", 1))


def anti(s: Spot) -> Column:
    return s.before.rlike(P.ANTI_BEFORE) | s.after.rlike(P.ANTI_AFTER)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(x, 4)))


def total(base: float, *points: tuple[Column, float]) -> Column:
    return clamp(sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0.0) for c, p in points), F.lit(base)))


def _minus(condition: Column) -> tuple[Column, float]:
    return condition, -X.ANTI_PENALTY


def passport(s: Spot) -> Column:
    year = F.substring(V.digits(s.raw), 3, 2).try_cast("int")
    return total(0.30, (s.near(P.PASSPORT_WORDS), 0.30), (s.raw.rlike(P.PAIRED_SERIES), 0.15), ((year <= 30) | (year >= 97), 0.10), _minus(anti(s)))


def snils(s: Spot) -> Column:
    return total(0.30, (V.snils(s.raw), 0.40), (s.near(P.SNILS_WORDS), 0.30), (s.raw.rlike(r"(?U)[-\s]"), 0.10), _minus(anti(s)))


def ogrn(s: Spot) -> Column:
    return total(0.30, (V.ogrn(s.raw), 0.40), (s.near(P.OGRN_WORDS), 0.30), _minus(anti(s)))


def kpp(s: Spot) -> Column:
    return total(0.20, (~s.before.rlike(P.KPP_OTHER_LABEL) & s.near(P.KPP_WORDS), 0.45), _minus(anti(s)))


def car_plate(s: Spot) -> Column:
    return total(0.65, (s.near(P.PLATE_WORDS), 0.20), _minus(anti(s)))


def driver_license(s: Spot) -> Column:
    paired = s.raw.rlike(P.PAIRED_SERIES) | s.raw.rlike(P.PAIRED_LETTERS)
    return total(0.30, (s.near(P.LICENSE_WORDS), 0.40), (paired, 0.15), _minus(anti(s)))


def oms(s: Spot) -> Column:
    return total(0.20, (V.luhn(V.digits(s.raw)), 0.25), (s.near(P.OMS_WORDS), 0.40), _minus(anti(s)))


def birthdate(s: Spot) -> Column:
    """The nearest birth word must belong to this date: no other date between them."""
    tail = F.regexp_extract(s.before, rf"(?isU)^.*(?:{P.BIRTH_WORDS})(.*)$", 1)
    related = s.before.rlike(f"(?iU){P.BIRTH_WORDS}") & ~tail.rlike(P.PATTERNS["BIRTHDATE"])
    return total(0.20, (related | s.after.rlike(P.BIRTH_AFTER), 0.50), _minus(s.before.rlike(P.BIRTH_OTHER_LABEL)))


def telegram(s: Spot) -> Column:
    return F.when(F.contains(F.lower(s.raw), F.lit("t.me/")), F.lit(0.80)).otherwise(total(0.30, (s.near(P.TELEGRAM_WORDS), 0.30)))


def bank_account(s: Spot) -> Column:
    """A bank code anywhere in the wide window proves the key; words count only close by."""
    number = V.digits(s.raw)
    close = Spot(s.raw, F.substring_index(F.when(s.before == "", "").otherwise(F.substring(s.before, -X.WINDOW_BEFORE, X.WINDOW_BEFORE)), "\n", -1), F.substring_index(F.substring(s.after, 1, X.WINDOW_AFTER), "\n", 1))
    prefix = F.substring(number, 1, 3)
    balance = prefix.isin(X.ACCOUNT_BALANCE_PREFIXES)
    structure = prefix.isin(X.ACCOUNT_STRUCTURE_PREFIXES) & F.substring(number, 6, 3).isin(X.ACCOUNT_CURRENCY_CODES)
    proven = F.exists(V.biks(F.concat(s.before, F.lit("\n"), s.after)), lambda b: V.account_key(number, b))
    return total(0.20, (proven, 0.60), (balance, 0.10), (balance & close.near(P.ACCOUNT_WORDS), 0.25), (structure, 0.40), _minus(anti(close)))


def coords(s: Spot) -> Column:
    values = F.transform(F.regexp_extract_all(s.raw, F.lit(P.DECIMAL), F.lit(0)), lambda v: F.abs(v.try_cast("double")))
    places = F.transform(F.regexp_extract_all(s.raw, F.lit(P.DECIMAL), F.lit(1)), F.length)
    two = F.size(values) == 2
    inside = two & (F.get(values, F.lit(0)) <= 90.0) & (F.get(values, F.lit(1)) <= 180.0)
    decimal = total(0.30, (s.near(P.COORDS_WORDS), 0.30), (inside, 0.10), (two & (F.array_min(places) >= 4), 0.15), _minus(anti(s)))
    return F.when(F.contains(s.raw, F.lit("°")), F.lit(0.70)).otherwise(decimal)


def ip(s: Spot) -> Column:
    return total(0.45, (s.near(P.IP_WORDS), 0.30), _minus(s.before.rlike(P.VERSION_BEFORE)))


SCORERS: dict[str, Callable[[Spot], Column]] = {
    "PASSPORT": passport, "SNILS": snils, "OGRN": ogrn, "OGRNIP": ogrn, "KPP": kpp, "BANK_ACCOUNT": bank_account,
    "CAR_PLATE": car_plate, "DRIVER_LICENSE": driver_license, "OMS": oms, "BIRTHDATE": birthdate, "TELEGRAM": telegram,
    "COORDS": coords, "IP": ip,
}
#: (before, after, across lines) of types whose window is not the usual one.
WINDOWS: dict[str, tuple[int, int, bool]] = {"BANK_ACCOUNT": (X.ACCOUNT_WINDOW, X.ACCOUNT_WINDOW, True)}


def score(kind: str, text: Column, raw: Column, start: Column, end: Column) -> Column:
    """Confidence of one match; types without a scorer are certain once they are valid."""
    if kind not in SCORERS:
        return F.lit(X.PATTERN_CONFIDENCE)
    return SCORERS[kind](Spot(raw, *context(text, start, end, *WINDOWS.get(kind, (X.WINDOW_BEFORE, X.WINDOW_AFTER, False)))))
