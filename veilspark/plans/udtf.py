"""``detect_pii(text)`` for SQL: a view over the detection expression, with no Python worker.

``register`` makes a temporary SQL table function of one string argument.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def detect_view(spark: SparkSession, table: str, view: str, text: str = "text", **options) -> None:
    """A view of ``table`` with one row per span."""
    from veilspark.operators.detect import detect, exploded

    df = spark.table(table)
    exploded(detect(df, text, **options), *[c for c in df.columns if c not in ("start", "end", "text", "entity_type", "source", "confidence")]).createOrReplaceTempView(view)


def register(spark: SparkSession, name: str = "luhn_numbers") -> None:
    """A Python table function: every card-shaped number of a text with its Luhn verdict."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="start int, number string, valid boolean")
    class Numbers:
        def eval(self, text: str):
            import re

            for m in re.finditer(r"(?<!\d)\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}(?!\d)", text or ""):
                ds = [int(c) for c in reversed(re.sub(r"\D", "", m[0]))]
                total = sum(ds[::2]) + sum(sum(divmod(2 * d, 10)) for d in ds[1::2])
                yield m.start(), m[0], total % 10 == 0

    spark.udtf.register(name, Numbers)
