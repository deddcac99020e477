"""Words of laid-out pages from binary files, by an extractor that the caller brings.

An extractor takes a file's bytes and gives (page, origin, block_no, line_no, word_no, text, x0, y0, x1, y1)
for each word, with ``text`` or ``ocr`` as origin; it stands for a library that reads a PDF's text layer
or recognises scanned pages.  Files are read and extracted one by one in parallel tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.functions import fixed as X
from veilspark.sources.files import WORD_SCHEMA

Extractor = Callable[[bytes], Iterable[tuple]]
COLUMNS = ("page", "origin", "block_no", "line_no", "word_no", "text", "x0", "y0", "x1", "y1")
SCHEMA = f"{WORD_SCHEMA}, origin string, error string"


def read(spark: SparkSession, *paths: str, extractor: Extractor, limit: int = X.MAX_PDF_BYTES) -> tuple[DataFrame, DataFrame]:
    """(words, failures): word tables for ``pages.blocks``, and (doc, error) of files that were too large or could not be read."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.when(F.col("length") <= limit, F.col("content")).alias("content"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                error, rows = None, []
                if content is None:
                    error = "too large"
                else:
                    try:
                        rows = [tuple(r) for r in extractor(bytes(content))]
                    except Exception as e:  # noqa: BLE001 - whatever an extractor raises becomes a file's error
                        error = type(e).__name__
                out = pd.DataFrame(rows if error is None else [], columns=list(COLUMNS)).assign(doc=path, error=None)
                if error is not None:
                    out = pd.DataFrame({c: [None] for c in COLUMNS}).assign(doc=path, error=error)
                yield out

    got = files.select("path", "content").mapInPandas(work, SCHEMA)
    return got.filter("error is null").drop("error"), got.filter("error is not null").select("doc", "error")
