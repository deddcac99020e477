"""Operator lists: allow entries drop spans, deny entries make spans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from veilspark.config import InvalidListEntryError
from veilspark.functions import fixed as X, patterns as P, spans as S
from veilspark.operators.morphology import Morphology, normalize_word

_TOKEN = re.compile(r"\w+(?:[-.@+/]\w+)*")


def validate_entries(entries: Sequence[str] | None, label: str) -> tuple[str, ...]:
    """Entries as a tuple; errors name an entry by number, never by content."""
    entries = tuple(entries or ())
    if len(entries) > X.MAX_LIST_ENTRIES:
        raise InvalidListEntryError(f"{label}: more than {X.MAX_LIST_ENTRIES} entries")
    for i, e in enumerate(entries):
        if not isinstance(e, str):
            raise InvalidListEntryError(f"{label}[{i}]: not a string")
        if len(e) > X.MAX_LIST_ENTRY_CHARS:
            raise InvalidListEntryError(f"{label}[{i}]: longer than {X.MAX_LIST_ENTRY_CHARS} characters")
        if not _TOKEN.search(e):
            raise InvalidListEntryError(f"{label}[{i}]: empty")
    return entries


def combine(configured: Sequence[str], call: Sequence[str] | None, label: str) -> tuple[str, ...]:
    """Configured and call entries; a call can only add."""
    return tuple(dict.fromkeys((*validate_entries(configured, label), *validate_entries(call, label))))


def first_form(token: Column, morph: Morphology) -> Column:
    """Lower case, ё as е; words of letters become the lemma of each hyphen part."""
    low = normalize_word(token)
    if not morph.available:
        return low
    parts = F.array_join(F.transform(F.split(low, "-"), morph.first_lemma), "-")
    return F.when(low.rlike(r"(?U)^[^\W\d_]+(?:-[^\W\d_]+)*$"), parts).otherwise(low)


def text_forms(token: Column, morph: Morphology) -> Column:
    """What a word of a text can be found by: itself and all its lemmas."""
    low = normalize_word(token)
    if not morph.available:
        return F.array(low)
    return (
        F.when(low.rlike(r"(?U)^[^\W\d_]+$"), F.array_union(morph.lemmas(low), F.array(low)))
        .when(low.rlike(r"(?U)^[^\W\d_]+(?:-[^\W\d_]+)+$"), F.array_distinct(F.array(low, first_form(token, morph))))
        .otherwise(F.array(low))
    )


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.LIST_TOKEN), F.lit(0))


def allow_key(text: Column, morph: Morphology) -> Column:
    """What two strings must share to be the same entry; empty for strings without words."""
    number = F.regexp_replace(text, r"(?U)\D", "")
    forms = F.transform(tokens(text), lambda t: first_form(t, morph))
    led = (F.size(forms) > 1) & F.get(forms, F.lit(0)).isin(X.ALLOW_LEGAL_FORMS)
    forms = F.when(led, F.slice(forms, 2, F.greatest(F.size(forms) - 1, F.lit(0)))).otherwise(forms)
    return F.when(F.length(number) >= X.DIGITS_ONLY_FROM, F.concat(F.lit("#"), number)).otherwise(F.array_join(forms, "\u0001"))


def drop_allowed(spans: Column, allow: Sequence[str], morph: Morphology) -> Column:
    """Spans whose whole text is an allow entry go: an anti-join on the key."""
    if not allow:
        return spans
    keys = F.array_distinct(F.transform(F.array(*map(F.lit, allow)), lambda e: allow_key(e, morph)))
    return F.filter(spans, lambda s: (allow_key(s.text, morph) == "") | ~F.array_contains(keys, allow_key(s.text, morph)))


def deny_spans(text: Column, deny: Sequence[str], morph: Morphology) -> Column:
    """At every word, the longest deny entry that begins there, as a CUSTOM span."""
    if not deny:
        return S.none()
    found = S.scan(text, P.LIST_TOKEN)
    words = F.transform(found, lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), text_forms(t.text, morph).alias("forms")))
    entries = F.array(*[F.transform(tokens(F.lit(e)), lambda t: F.array_distinct(F.array(first_form(t, morph), normalize_word(t)))) for e in deny])

    def fits(entry: Column, i: Column) -> Column:
        def at(j: Column) -> Column:
            w = F.get(words, i + j)
            gap = S.cut(text, F.get(words, i + j - 1).end, w.start)
            return F.arrays_overlap(w.forms, F.get(entry, j)) & ((j == 0) | gap.rlike(P.LIST_GAP))

        return (i + F.size(entry) <= F.size(words)) & F.forall(F.sequence(F.lit(0), F.size(entry) - 1), lambda j: F.coalesce(at(j), F.lit(False)))

    def longest(w: Column, i: Column) -> Column:
        ends = F.transform(F.filter(entries, lambda e: fits(e, i)), lambda e: F.get(words, i + F.size(e) - 1).end)
        end = F.array_max(ends)
        return F.when(end.isNotNull(), S.make(w.start, end, S.cut(text, w.start, end), "CUSTOM", "deny", X.DENY_CONFIDENCE))

    return F.filter(F.transform(words, longest), lambda s: s.isNotNull())
