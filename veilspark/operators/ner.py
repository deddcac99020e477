"""Named-entity layer: providers of person, place and organization spans.

``NoNer`` is the mode without a model.  ``ColumnNer`` takes spans that a model wrote to a column,
``PandasNer`` runs a function over batches of texts, loaded once for each Python worker, and
``RuleNer`` finds street, house and room by pattern; it is no substitute for a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.functions import fixed as X, patterns as P, spans as S

STREET = r"(?iU)(?<!\w)(?:ул\.|улица|пр-т|проспект|пер\.|переулок|наб\.|набережная|ш\.|шоссе|бульвар|б-р)\s*[А-ЯЁ][\wё-]*(?:\s[А-ЯЁ][\wё-]*)?"


class NoNer:
    available = False

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, S.none())


@dataclass(frozen=True)
class ColumnNer:
    """Spans (start, end, entity_type[, confidence]) of a column of the table."""

    column: str
    available = True

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        has = "confidence" in df.schema[self.column].dataType.elementType.names
        conf = (lambda s: F.coalesce(s.confidence, F.lit(X.NER_CONFIDENCE))) if has else (lambda s: F.lit(X.NER_CONFIDENCE))
        made = F.transform(F.col(self.column), lambda s: S.make(s.start, s.end, S.cut(F.col(text), s.start, s.end), s.entity_type, "natasha", conf(s)))
        return df.withColumn(out, F.coalesce(made, S.none()))


@dataclass(frozen=True)
class PandasNer:
    """``load()`` runs once for each worker and gives a function from a text to (start, end, type) triples."""

    load: Callable[[], Callable[[str], list[tuple[int, int, str]]]]
    available = True

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<struct<start:int,end:int,entity_type:string>>")
        def tag(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in texts:
                yield batch.map(lambda t: [{"start": a, "end": b, "entity_type": k} for a, b, k in model(t)] if t else [])

        return ColumnNer(out).add(df.withColumn(out, tag(F.col(text))), text, out)


class RuleNer:
    """Streets by pattern; the house number right after a street, the room right after the house."""

    available = True

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        t = F.col(text)

        def parts(m: Column) -> Column:
            rest = F.substr(t, m.end + 1, F.lit(60))
            whole = F.regexp_substr(rest, F.lit(P.HOUSE))
            house = F.regexp_extract(rest, P.HOUSE, 1)
            h_end = m.end + F.length(whole)
            h_start = h_end - F.length(house)
            after = F.substr(t, h_end + 1, F.lit(60))
            room = F.regexp_extract(after, P.ROOM, 1)
            r_end = h_end + F.length(F.regexp_substr(after, F.lit(P.ROOM)))
            return F.array(
                S.make(m.start, m.end, m.text, "LOC", "natasha", X.ADDRESS_CONFIDENCE),
                F.when(whole.isNotNull(), S.make(h_start, h_end, house, "LOC", "natasha", X.HOUSE_CONFIDENCE)),
                F.when(whole.isNotNull() & (room != ""), S.make(r_end - F.length(room), r_end, room, "LOC", "natasha", X.HOUSE_CONFIDENCE)),
            )

        found = F.flatten(F.transform(S.scan(t, STREET), parts))
        return df.withColumn(out, F.coalesce(F.filter(found, lambda s: s.isNotNull()), S.none()))


def add_uncovered(spans: Column, more: Column) -> Column:
    """Add spans that no earlier one contains (an anti-join on containment)."""
    return F.aggregate(more, spans, lambda acc, m: F.when(F.exists(acc, lambda s: (s.start <= m.start) & (s.end >= m.end)), acc).otherwise(F.concat(acc, F.array(m))))
