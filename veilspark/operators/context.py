"""Contextual layer: named entities against patterns, word lists and the words before them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilspark.functions import fixed as X, spans as S
from veilspark.operators.morphology import Morphology

_EDGE = "[«»\"'(),.!?;:`\\s]"


def strip_edges(word: Column) -> Column:
    return F.regexp_replace(word, f"(?U)^{_EDGE}+|{_EDGE}+$", "")


def single_word(text: Column) -> Column:
    """The one word of letters that a span is, or null."""
    bare = strip_edges(text)
    return F.when(bare.rlike(r"(?U)^[^\W\d_]+$"), bare)


def words_before(text: Column, start: Column, n: int = X.LOOKBACK_WORDS) -> Column:
    """The last words before a position, in lower case."""
    parts = F.filter(F.split(F.lower(F.substr(text, F.lit(1), start)), r"(?U)\s+"), lambda w: w != "")
    return F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n)


def _any_of(words: Column, values: list[str]) -> Column:
    return F.exists(words, lambda w: w.isin(values) | strip_edges(w).isin(values))


def is_false_person(span: Column, text: Column, morph: Morphology) -> Column:
    """A single common word taken for a person: on the whitelist, or known and neither name nor place.

    A known common word stays if a person marker stands among the words before it.
    """
    word = single_word(span.text)
    low = F.lower(word)
    listed = low.isin(X.WHITELIST) | F.exists(morph.lemmas(word), lambda x: x.isin([w.replace("ё", "е") for w in X.WHITELIST]))
    if not morph.available:
        return F.coalesce(word.isNotNull() & low.isin(X.WHITELIST), F.lit(False))
    named = F.arrays_overlap(morph.readings(word), F.array(*map(F.lit, ("Name", "Surn", "Patr", "Geox"))))
    marked = _any_of(words_before(text, span.start), X.PERSON_MARKERS)
    return F.coalesce(word.isNotNull() & (listed | (morph.is_known(word) & ~named & ~marked)), F.lit(False))


def has_place_context(text: Column, start: Column) -> Column:
    return _any_of(words_before(text, start), X.PLACE_PREPOSITIONS + X.PLACE_VERBS)


def resolved_type(span: Column, text: Column, morph: Morphology) -> Column:
    """PER stays with a person reading; otherwise a place context makes it LOC."""
    place = has_place_context(text, span.start)
    if not morph.available:
        return F.when(place, F.lit("LOC")).otherwise(F.lit("PER"))
    word = F.coalesce(single_word(span.text), span.text)
    person = F.arrays_overlap(morph.readings(word), F.array(*map(F.lit, ("Name", "Surn", "Patr"))))
    return F.when(F.coalesce(person, F.lit(False)), F.lit("PER")).when(place, F.lit("LOC")).otherwise(F.lit("PER"))


def validate(patterns: Column, entities: Column, text: Column, morph: Morphology) -> Column:
    """Pattern spans win their ranges; what is left of entities is filtered, retyped and merged in."""
    rest = F.flatten(F.transform(entities, lambda s: S.subtract(s, patterns, text)))
    rest = F.filter(rest, lambda s: ~((s.entity_type == "PER") & (F.lower(F.trim(s.text)).isin(X.WHITELIST) | is_false_person(s, text, morph))))

    def retype(s: Column) -> Column:
        moved = (s.entity_type == "PER") & (resolved_type(s, text, morph) == "LOC")
        return F.when(moved, S.make(s.start, s.end, s.text, "LOC", "context", X.RESOLVED_CONFIDENCE)).otherwise(s)

    return S.merge(F.concat(patterns, F.transform(rest, retype)), text, S.first)
