"""Detection: patterns, entities, context, threshold, lists - one narrow stage over documents."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from datetime import date

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.config import EngineConfig, threshold
from veilspark.functions import patterns as P, scoring, spans as S, validators
from veilspark.operators import context, lists
from veilspark.operators.morphology import Morphology
from veilspark.operators.ner import NoNer


def candidates(text: Column, kind: str, min_confidence: float, today: date) -> Column:
    """Matches of one pattern that pass its check and reach the threshold.

    Rejected matches have used up their characters: they are taken first and judged after.
    """
    found = S.scan(text, P.PATTERNS[kind])
    checked = F.filter(found, lambda m: validators.valid(kind, m.text, today))
    made = F.transform(checked, lambda m: S.make(m.start, m.end, m.text, kind, "pattern", scoring.score(kind, text, m.text, m.start, m.end)))
    return F.filter(made, lambda s: s.confidence >= min_confidence)


def pattern_spans(text: Column, min_confidence: float, today: date, kinds: Sequence[str] | None = None) -> Column:
    """Layer 1.  Texts without anything that a pattern needs are not scanned."""
    every = F.concat(*[candidates(text, k, min_confidence, today) for k in P.PATTERNS if kinds is None or k in kinds])
    return F.when(text.rlike(P.GUARD), S.merge(every, text, S.by_evidence)).otherwise(S.none())


@functools.lru_cache(maxsize=64)
def _pattern_column(gateway: int, text: str, min_confidence: float, today: date, kinds: tuple[str, ...] | None) -> Column:
    return F.coalesce(pattern_spans(F.col(text), min_confidence, today, kinds), S.none())


def pattern_column(text: str, min_confidence: float, today: date, kinds: Sequence[str] | None = None) -> Column:
    """Layer 1 of a column, built once for each setting: it takes tens of thousands of calls into the JVM."""
    gateway = id(SparkContext._gateway)  # columns live as long as their JVM
    return _pattern_column(gateway, text, min_confidence, today, None if kinds is None else tuple(kinds))


def detect(df: DataFrame, text: str = "text", config: EngineConfig | None = None, min_confidence: float | None = None,
           allow: Sequence[str] | None = None, deny: Sequence[str] | None = None, kinds: Sequence[str] | None = None,
           ner=None, morph: Morphology | None = None) -> DataFrame:
    """Adds ``spans`` and ``layer_stats`` (spans after each layer); columns of these names are replaced.

    Null texts have no spans.  Every step is an expression of the row: nothing is shuffled.
    """
    config, ner, morph = config or EngineConfig(), ner or NoNer(), morph or Morphology()
    least = threshold(min_confidence, config)
    allow = lists.combine(config.allow, allow, "allow_list")
    deny = lists.combine(config.deny, deny, "deny_list")
    t = F.col(text)
    out = df.withColumn("_p", pattern_column(text, least, config.day(), kinds))
    out = ner.add(out, text, "_n")
    if ner.available:
        out = out.withColumn("_c", context.validate(F.col("_p"), F.col("_n"), t, morph))
    else:
        out = out.withColumn("_c", F.col("_p"))
    final = lists.drop_allowed(F.filter("_c", lambda s: s.confidence >= least), allow, morph)
    if deny:
        final = S.merge(F.concat(final, F.coalesce(lists.deny_spans(t, deny, morph), S.none())), t, S.existing)
    stats = F.create_map(F.lit("pattern"), F.size("_p"), F.lit("natasha"), F.size("_n"), F.lit("context"), F.size("_c"))
    return out.withColumns({"spans": final, "layer_stats": stats}).drop("_p", "_n", "_c")


def exploded(detected: DataFrame, *keys: str) -> DataFrame:
    """One row per span: keys, start, end, text, entity_type, source, confidence."""
    return detected.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.*")


def entity_counts(detected: DataFrame, *keys: str) -> DataFrame:
    """Spans by keys and type; counts only, never values."""
    kinds = detected.select(*keys, F.explode(F.transform("spans", lambda s: s.entity_type)).alias("entity_type"))
    return kinds.groupBy(*keys, "entity_type").agg(F.count("*").alias("n"))


def split_by_length(df: DataFrame, text: str = "text", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to process, rows over the length limit)."""
    limit = EngineConfig().max_text_length if limit is None else limit
    long = F.coalesce(F.length(F.col(text)) > limit, F.lit(False))
    return df.filter(~long), df.filter(long)
