"""Audit: types and counts, never values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PREVIEW = 200


def detection_events(detected: DataFrame, text: str = "text", at: str | None = None) -> DataFrame:
    """One event for each row with spans: distinct types, counts by type, text length, time."""
    kinds = F.transform("spans", lambda s: s.entity_type)
    names = F.array_sort(F.array_distinct(kinds))
    counts = F.map_from_arrays(names, F.transform(names, lambda k: F.size(F.filter(kinds, lambda x: x == k))))
    return detected.filter(F.size("spans") > 0).select(
        names.alias("entity_types"), counts.alias("counts"), F.length(F.col(text)).alias("text_length"),
        (F.col(at) if at else F.current_timestamp()).alias("ts"),
    )


def llm_events(requests: DataFrame, masked: str = "masked_text") -> DataFrame:
    """One event for each request: success, error, the first characters of the masked text."""
    return requests.select(F.col("success"), F.col("error"), F.substring(F.col(masked), 1, PREVIEW).alias("preview"))


def session_stats(detections: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row: total_entities, entity_counts map, llm_requests, llm_success, llm_failed, duration_seconds."""
    by = detections.select(F.explode("counts").alias("t", "n")).groupBy("t").agg(F.sum("n").alias("n"))
    totals = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_entities"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "n")))).alias("entity_counts"))
    span = detections.agg(F.round(F.coalesce(F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp")), F.lit(0)) / 1e6, 2).alias("duration_seconds"))
    if requests is None:
        calls = detections.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("llm_requests", "llm_success", "llm_failed")])
    else:
        calls = requests.agg(F.count("*").alias("llm_requests"), F.count_if("success").alias("llm_success"), F.count_if(~F.col("success")).alias("llm_failed"))
    one = F.lit(1)  # each side is one row
    return totals.withColumn("_k", one).join(calls.withColumn("_k", one), "_k").join(span.withColumn("_k", one), "_k").drop("_k")
