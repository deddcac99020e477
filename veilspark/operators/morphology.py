"""Word forms: a dimension of (word, lemmas, first_lemma, readings, is_known), or its absence.

Without the dimension every word is its own lemma, has no reading and is unknown.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

MAX_WORDS = 20_000


def normalize_word(word: Column) -> Column:
    return F.translate(F.lower(word), "ё", "е")


@dataclass(frozen=True)
class Morphology:
    """Look-ups in a dimension of at most ``MAX_WORDS`` words, held as literal maps."""

    words: dict[str, tuple[tuple[str, ...], str, tuple[str, ...], bool]] = field(default_factory=dict)

    @classmethod
    def from_table(cls, dim: DataFrame) -> Morphology:
        rows = dim.select("word", "lemmas", "first_lemma", "readings", "is_known").limit(MAX_WORDS + 1).collect()
        if len(rows) > MAX_WORDS:
            raise ValueError(f"more than {MAX_WORDS} words; join larger dictionaries with ``lemmatize``")
        return cls({r.word: (tuple(r.lemmas), r.first_lemma, tuple(r.readings), r.is_known) for r in rows})

    @property
    def available(self) -> bool:
        return bool(self.words)

    def _map(self, at: int) -> Column:
        """One literal: the optimizer folds it, so that plans do not grow with the dictionary."""
        kind = ("array<string>", "string", "array<string>", "boolean")[at]
        return F.from_json(F.lit(json.dumps({w: v[at] for w, v in self.words.items()}, ensure_ascii=False)), f"map<string,{kind}>")

    def _look(self, word: Column, at: int, default: Column) -> Column:
        return F.coalesce(F.try_element_at(self._map(at), normalize_word(word)), default) if self.words else default

    def lemmas(self, word: Column) -> Column:
        return self._look(word, 0, F.array(normalize_word(word)))

    def first_lemma(self, word: Column) -> Column:
        return self._look(word, 1, normalize_word(word))

    def readings(self, word: Column) -> Column:
        return self._look(word, 2, F.array().cast("array<string>"))

    def is_known(self, word: Column) -> Column:
        return self._look(word, 3, F.lit(False))


def lemmatize(words: DataFrame, dim: DataFrame, word: str = "word") -> DataFrame:
    """Join a dictionary of any size: adds lemmas, first_lemma, readings, is_known, with the defaults for absent words."""
    key = normalize_word(F.col(word))
    d = dim.select(F.col("word").alias("_w"), *[F.col(c).alias(f"_{c}") for c in ("lemmas", "first_lemma", "readings", "is_known")])
    out = words.withColumn("_key", key).join(d, F.col("_key") == F.col("_w"), "left")
    return out.select(
        *words.columns, F.coalesce("_lemmas", F.array("_key")).alias("lemmas"), F.coalesce("_first_lemma", "_key").alias("first_lemma"),
        F.coalesce("_readings", F.array().cast("array<string>")).alias("readings"), F.coalesce("_is_known", F.lit(False)).alias("is_known"),
    )
