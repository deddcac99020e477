"""The engine's calls: detect, mask, demask, process, files and pages, all on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veilspark.config import EngineConfig, TextTooLongError
from veilspark.operators import audit, mask as masking, pages
from veilspark.operators.detect import detect, entity_counts, split_by_length
from veilspark.operators.morphology import Morphology
from veilspark.operators.ner import NoNer
from veilspark.sources import files, llm_connector
from veilspark.streaming import handles


class Engine:
    """Settings and providers of a session; every call returns tables and runs nothing by itself."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, ner=None, morph: Morphology | None = None):
        self.spark = spark
        self.config = config or EngineConfig.from_spark(spark)
        self.ner, self.morph = ner or NoNer(), morph or Morphology()

    @property
    def ner_available(self) -> bool:
        return self.ner.available

    def detect(self, df: DataFrame, text: str = "text", **call) -> DataFrame:
        return detect(df, text, self.config, ner=self.ner, morph=self.morph, **call)

    def mask(self, df: DataFrame, text: str = "text", **call) -> DataFrame:
        """Adds spans, layer_stats, masked_text and mapping."""
        return masking.mask(self.detect(df, text, **call), text)

    def mask_with_handle(self, df: DataFrame, text: str = "text", deny: Sequence[str] | None = None, min_confidence: float | None = None) -> DataFrame:
        """As ``mask``, with a new handle and its time for each row."""
        return handles.register(self.mask(df, text, deny=deny, min_confidence=min_confidence))

    def demask(self, texts: DataFrame, registered: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
        """(answers, handles left): answers are (handle, text, restored_text, status) for texts (handle, text).

        A handle works once.  Unknown, expired and used handles are marked; of several texts with one
        handle the smallest gets it.  Pass the handles that are left to the next call.
        """
        alive = registered if now is None else handles.live(registered, now, self.config.ttl_seconds)
        nth = F.row_number().over(Window.partitionBy("handle").orderBy("text"))
        got = texts.select("handle", "text", nth.alias("_nth")).join(alive.select("handle", "mapping", F.lit(True).alias("_live")), "handle", "left")
        ok = F.coalesce(F.col("_live") & (F.col("_nth") == 1), F.lit(False))
        restored = F.when(ok, masking.restored(F.col("text"), F.col("mapping")))
        answers = got.select("handle", "text", restored.alias("restored_text"), F.when(ok, "ok").otherwise("unknown handle").alias("status"))
        return answers, alive.join(texts.select("handle").distinct(), "handle", "left_anti")

    def process(self, df: DataFrame, text: str = "text", connect=llm_connector.echo, system: str | None = None, **call) -> tuple[DataFrame, DataFrame]:
        """(results, rows over the length limit): detect, mask, ask, restore."""
        fine, long = split_by_length(df, text, self.config.max_text_length)
        asked = llm_connector.ask(self.mask(fine, text, **call), connect, system=system)
        out = F.when(F.col("response") != "", masking.restored(F.col("response"), F.col("mapping"))).otherwise("")
        return asked.withColumn("llm_response", out).drop("mapping"), long

    def process_text(self, text: str, **call) -> dict:
        """One text; a longer one than the limit is an error."""
        if len(text) > self.config.max_text_length:
            raise TextTooLongError(f"more than {self.config.max_text_length} characters")
        r = self.process(files.one_text(self.spark, text), **call)[0].first()
        counts: dict[str, int] = {}
        for x in r.spans:
            counts[x.entity_type] = counts.get(x.entity_type, 0) + 1
        return {"anonymized_text": r.masked_text, "llm_response": r.llm_response, "stats": {"entities_detected": len(r.spans), "entity_types": r.layer_stats}, "counts": counts}

    def detect_files(self, *paths: str, **call) -> DataFrame:
        """(path, entity_counts): counts by type of whole text files."""
        counts = entity_counts(self.detect(files.text_files(self.spark, *paths).filter("valid"), **call), "path")
        return counts.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("entity_counts"))

    def mask_files(self, *paths: str, **call) -> DataFrame:
        """Whole text files, masked, with handles and the name of the masked file."""
        rows = self.mask_with_handle(files.text_files(self.spark, *paths).filter("valid"), **call)
        return rows.withColumn("masked_path", F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("_masked.txt")))

    def write_masked_files(self, folder: str, *paths: str, **call) -> DataFrame:
        """As ``mask_files``; the masked texts lie in ``folder``, one subfolder for each handle, and the table of handles is written beside them."""
        rows = self.mask_files(*paths, **call).select("handle", "created_at", "path", "masked_path", "masked_text", "mapping")
        rows.write.mode("append").parquet(f"{folder}/_handles")  # handles are drawn here, once
        kept = self.spark.read.parquet(f"{folder}/_handles")
        files.write_masked(kept, folder)
        return kept.drop("masked_text")

    def close_masked_files(self, folder: str, closed: DataFrame) -> None:
        """Delete the masked files of handles that were popped, closed or swept; unknown ones are passed over."""
        files.delete_masked(self.spark, folder, closed)

    def detect_pages(self, words: DataFrame, **call) -> DataFrame:
        """(doc, pages): counts by page and type."""
        return pages.page_maps(pages.entity_counts(self.detect(pages.blocks(words), **call)))

    def mask_pages(self, words: DataFrame, **call) -> tuple[DataFrame, DataFrame]:
        """((doc, text), mapping table): page texts masked with tokens shared by all pages of a file."""
        found = self.mask(pages.page_text(pages.blocks(words)), **call)
        return pages.file_text(found, "masked_text"), masking.mapping_table(found, "doc", "page")

    def redact_pages(self, words: DataFrame, entity_types: Sequence[str] | None = None, redact_urls: bool | None = None, **call) -> tuple[DataFrame, DataFrame]:
        """(boxes, summary by document)."""
        urls = self.config.redact_urls if redact_urls is None else redact_urls
        return pages.redact(words, entity_types, urls, config=self.config, ner=self.ner, morph=self.morph, **call)

    def stats(self, detected: DataFrame, requests: DataFrame | None = None) -> DataFrame:
        return audit.session_stats(audit.detection_events(detected), requests)
