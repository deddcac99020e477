"""Readers and writers of texts, PDFs, benchmarks and masked output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.functions import fixed as X

EXAMPLE_SCHEMA = "id string, domain string, text string, entities array<struct<start:int,end:int,type:string>>"
WORD_SCHEMA = "doc string, page int, block_no int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"
MAPPING_SCHEMA = "handle string, ord int, token string, original string, entity_type string"


def one_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text): whole files as UTF-8; ``valid`` is false where the bytes are no UTF-8."""
    raw = spark.read.format("binaryFile").load(list(paths))
    return raw.select("path", F.col("content").cast("string").alias("text"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))


def pdf_files(spark: SparkSession, *paths: str, limit: int = X.MAX_PDF_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files to process, files over the size limit) of binary PDFs."""
    raw = spark.read.format("binaryFile").load(list(paths)).filter(F.lower("path").endswith(".pdf"))
    return raw.filter(F.col("length") <= limit), raw.filter(F.col("length") > limit).select("path", "length")


def examples(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark: explicit schema, null entities as none."""
    df = spark.read.schema(EXAMPLE_SCHEMA).parquet(path)
    return df.withColumn("entities", F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,type:string>>")))


def words(spark: SparkSession, path: str) -> DataFrame:
    """Stored word tables; words without an origin are of the text layer."""
    df = spark.read.schema(f"{WORD_SCHEMA}, origin string").parquet(path)
    return df.withColumn("origin", F.coalesce("origin", F.lit("text")))


def write_masked(df: DataFrame, folder: str, handle: str = "handle", text: str = "masked_text") -> None:
    """One folder for each handle, the masked text as a text file."""
    df.select(handle, text).write.partitionBy(handle).mode("append").text(folder)


def delete_masked(spark: SparkSession, folder: str, handles: DataFrame, handle: str = "handle") -> int:
    """Delete the folders of these handles; returns how many were there.  One call for each handle, on the driver."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for r in handles.select(handle).distinct().toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{handle}={r[0]}")
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def write_misses(misses: DataFrame, folder: str) -> None:
    """Missed entities (no text) as JSON lines."""
    misses.select("id", "type", "start", "end").write.mode("overwrite").json(folder)


def append_audit(events: DataFrame, folder: str) -> None:
    events.write.mode("append").parquet(folder)
