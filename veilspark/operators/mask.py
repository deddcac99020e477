"""Masking: deterministic tokens for spans, mapping tables, and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilspark.functions import fixed as X, spans as S

MAPPING = "array<struct<token:string,original:string,entity_type:string>>"
_FORMS = "|".join(X.MASK_LEGAL_FORMS)


def _bare(text: Column) -> Column:
    """Without punctuation at the edges, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)^[^\w]+|[^\w]+$", ""), r"(?U)\s+", " "))


def normalized(kind: Column, text: Column) -> Column:
    """What mentions of one entity share; organizations lose a legal form at either edge."""
    low = _bare(F.lower(text))
    org = F.regexp_replace(low, rf"(?U)^(?:{_FORMS})\b\.?\s*", "")
    org = _bare(F.regexp_replace(org, rf"(?U)\s*\b(?:{_FORMS})\.?$", ""))
    return F.when(kind == "ORG", org).otherwise(low)


def token(kind: Column, text: Column) -> Column:
    """``<TYPE_XXXXXXXX>``: eight hex digits of the key's SHA-256, the same in every run."""
    key = F.concat_ws(":", kind, normalized(kind, text))
    return F.concat(F.lit("<"), kind, F.lit("_"), F.upper(F.substring(F.sha2(key, 256), 1, 8)), F.lit(">"))


def masked_text(text: Column, spans: Column) -> Column:
    """The text with each span as its token; spans are disjoint."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), token(s.entity_type, s.text).alias("token"))))

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s.end.alias("at"), F.concat(acc.out, S.cut(text, acc.at, s.start), s.token).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a.out, F.substr(text, a.at + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def mapping(spans: Column) -> Column:
    """(token, original, type) by first mention, in reading order."""
    ordered = F.transform(S.in_order(spans), lambda s: F.struct(token(s.entity_type, s.text).alias("token"), s.text.alias("original"), s.entity_type.alias("entity_type")))

    def step(acc: Column, m: Column) -> Column:
        return F.when(F.exists(acc, lambda a: a.token == m.token), acc).otherwise(F.concat(acc, F.array(m)))

    return F.aggregate(ordered, F.array().cast(MAPPING), step)


def mask(detected: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``masked_text`` and ``mapping`` to a detected table."""
    return detected.withColumn("masked_text", masked_text(F.col(text), F.col("spans"))).withColumn("mapping", mapping(F.col("spans")))


def restored(text: Column, mapping_: Column) -> Column:
    """Every token replaced by its first mention's text, in the mapping's order."""
    return F.aggregate(F.coalesce(mapping_, F.array().cast(MAPPING)), text, lambda acc, m: F.replace(acc, m.token, m.original))


def demask(df: DataFrame, text: str = "masked_text", mapping_: str = "mapping", out: str = "restored_text") -> DataFrame:
    return df.withColumn(out, restored(F.col(text), F.col(mapping_)))


def mapping_table(detected: DataFrame, *keys: str) -> DataFrame:
    """One mapping for each key (a handle, a file), shared by its rows: first mention wins.

    Rows are in the order of the columns after the first key.  Also counts distinct keys behind
    one token, so that collisions of the 32-bit tokens show.
    """
    rows = detected.select(*keys, F.explode("spans").alias("s")).select(
        *keys, token(F.col("s.entity_type"), F.col("s.text")).alias("token"), F.col("s.text").alias("original"),
        F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start"), normalized(F.col("s.entity_type"), F.col("s.text")).alias("norm"),
    )
    order = F.struct(*keys[1:], "start")
    return rows.groupBy(keys[0], "token").agg(
        F.min_by("original", order).alias("original"), F.min_by("entity_type", order).alias("entity_type"),
        F.min(order).alias("first"), F.count("*").alias("mentions"), F.countDistinct("norm").alias("n_keys"),
    ).withColumn("ord", F.row_number().over(Window.partitionBy(keys[0]).orderBy("first", "token"))).drop("first")


def demask_with_table(df: DataFrame, table: DataFrame, key: str, text: str = "masked_text", out: str = "restored_text") -> DataFrame:
    """Join texts with the mapping table of their key and restore them."""
    per = table.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "token", "original", "entity_type"))), lambda m: F.struct(m.token.alias("token"), m.original.alias("original"), m.entity_type.alias("entity_type"))).alias("_m"))
    return df.join(per, key, "left").withColumn(out, restored(F.col(text), F.col("_m"))).drop("_m")
