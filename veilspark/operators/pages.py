"""Laid-out pages: words to blocks of text, detection on blocks, words and boxes to redact.

Word tables have (doc, page, block_no, line_no, word_no, text, x0, y0, x1, y1, origin); reading
words from files is a connector's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from veilspark.functions import fixed as X, spans as S
from veilspark.operators.detect import detect

KEYS = ("doc", "page", "origin", "block_no")
BOX = ("x0", "y0", "x1", "y1")
WORD = "struct<text:string,start:int,end:int,x0:double,y0:double,x1:double,y1:double>"


def _reader() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted words to blocks, as functions that go to workers by value."""

    def changes(columns: list[pa.ChunkedArray]) -> np.ndarray:
        """Rows that differ from the row before in any column; nulls are equal."""
        out = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
        for c in columns:
            c = c.combine_chunks()
            a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            out |= ~same.to_numpy(zero_copy_only=False)
        return out

    def join_words(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        """Whole blocks as rows: their text and their words with offsets; ``first`` has the places of first words."""
        n, text, line = len(t), t["text"].combine_chunks(), t["line_no"].combine_chunks()
        ends = np.append(first[1:], n)
        last = np.zeros(n, dtype=bool)
        last[ends - 1] = True
        differs = pc.fill_null(pc.not_equal(line.slice(1), line.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        new_line = np.append(differs, False) & ~last
        wraps = new_line & pc.and_(pc.greater(pc.utf8_length(text), 1), pc.ends_with(text, "-")).to_numpy(zero_copy_only=False)
        kept = pc.if_else(pa.array(wraps), pc.utf8_slice_codeunits(text, 0, -1), text)
        gap = pc.if_else(pa.array(last | wraps), "", pc.if_else(pa.array(new_line), "\n", " "))
        piece = pc.binary_join_element_wise(kept, gap.cast(kept.type), pa.scalar("", kept.type))
        size = pc.utf8_length(piece).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        start -= np.repeat(start[first], ends - first)
        end = start + pc.utf8_length(kept).to_numpy(zero_copy_only=False)
        at = pa.array(np.append(first, n).astype(np.int32))
        fields = {"text": kept, "start": pa.array(start.astype(np.int32)), "end": pa.array(end.astype(np.int32)), **{c: t[c].combine_chunks() for c in BOX}}
        words = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
        keys = [t[k].combine_chunks().take(pa.array(first)) for k in KEYS]
        return pa.RecordBatch.from_arrays([*keys, pc.binary_join(pa.ListArray.from_arrays(at, piece), ""), words], names=[*KEYS, "text", "words"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted words to blocks; of a block that goes on in the next batch only its batches are held."""
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            tail = [held[-1].slice(len(held[-1]) - 1)] if held else []
            seam = pa.concat_tables([*tail, t])
            starts = np.flatnonzero(changes([seam[k] for k in KEYS])) + 1 - len(tail)  # in ``t``
            if len(starts):
                whole = pa.concat_tables([*held, t.slice(0, starts[-1])])
                before = sum(map(len, held))
                if len(whole):
                    yield join_words(whole, np.unique(np.append(0, starts[:-1] + before)))
                held, t = [], t.slice(starts[-1])
            held.append(t)
        if held:
            yield join_words(pa.concat_tables(held), np.array([0]))

    return read


def blocks(words: DataFrame) -> DataFrame:
    """(doc, page, origin, block_no, text, words): blocks in reading order of their words.

    Words of a line are joined by a space, lines by a newline; a line that ends in a hyphen
    attached to a word runs on into the next without either.  Words are sorted by Spark and joined
    as they stream by, so that a task holds one block and a block costs its own length.
    """
    clean = words.filter(F.trim("text") != "").select(*KEYS, F.col("line_no").cast("int").alias("line_no"), F.col("word_no").cast("int").alias("word_no"), "text", *[F.col(c).cast("double").alias(c) for c in BOX])
    schema = StructType([*[clean.schema[k] for k in KEYS], StructField("text", StringType()), StructField("words", ArrayType(DataType.fromDDL(WORD)))])
    return clean.repartition(*KEYS).sortWithinPartitions(*KEYS, "line_no", "word_no", "text", *BOX).mapInArrow(_reader(), schema)


def without_covered(ocr: DataFrame, layer: DataFrame) -> DataFrame:
    """OCR words whose centre lies in no box of the text layer (a spatial anti-join within a page)."""
    box = layer.select("doc", "page", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("o.x0") + F.col("o.x1")) / 2, (F.col("o.y0") + F.col("o.y1")) / 2
    inside = cx.between(F.col("b._x0"), F.col("b._x1")) & cy.between(F.col("b._y0"), F.col("b._y1"))
    return ocr.alias("o").join(box.alias("b"), (F.col("o.doc") == F.col("b.doc")) & (F.col("o.page") == F.col("b.page")) & inside, "left_anti")


def scaled(ocr_words: DataFrame, zoom: float = X.OCR_ZOOM) -> DataFrame:
    """Pixel boxes of a zoomed rendering as page coordinates; blank words go."""
    return ocr_words.filter(F.trim("text") != "").withColumns({c: F.col(c) / zoom for c in ("x0", "y0", "x1", "y1")})


def page_words(layer: DataFrame, ocr: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Words to work on: the text layer, and OCR where a page has no text or has images (``pages.has_images``)."""
    layer = layer.withColumn("origin", F.lit("text"))
    if ocr is None:
        return layer
    texts = layer.select("doc", "page").distinct().withColumn("has_text", F.lit(True))
    wanted = ocr.join(texts, ["doc", "page"], "left")
    if pages is not None:
        wanted = wanted.join(pages.select("doc", "page", "has_images"), ["doc", "page"], "left")
    else:
        wanted = wanted.withColumn("has_images", F.lit(False))
    wanted = wanted.filter("has_text is null or has_images").drop("has_text", "has_images").withColumn("origin", F.lit("ocr"))
    return layer.unionByName(without_covered(wanted, layer))


def page_text(block_rows: DataFrame, text: str = "text") -> DataFrame:
    """(doc, page, text): blocks by newline, the text layer first."""
    parts = F.sort_array(F.collect_list(F.struct((F.col("origin") == "ocr").alias("o"), "block_no", F.col(text).alias("t"))))
    return block_rows.groupBy("doc", "page").agg(F.array_join(F.transform(parts, lambda p: p.t), "\n").alias("text"))


def file_text(page_rows: DataFrame, text: str = "text") -> DataFrame:
    """(doc, text): pages (from 0) under a heading with their number from 1, a blank line between them."""
    parts = F.sort_array(F.collect_list(F.struct("page", F.col(text).alias("t"))))
    joined = F.transform(parts, lambda p: F.concat(F.lit("--- Страница "), (p.page + 1).cast("string"), F.lit(" ---\n"), p.t))
    return page_rows.groupBy("doc").agg(F.array_join(joined, "\n\n").alias("text"))


def wanted_types(kind: Column, entity_types: Sequence[str] | None = None, redact_urls: bool = False) -> Column:
    """An explicit list of types, or all but URL unless asked for."""
    if entity_types is not None:
        return kind.isin(list(entity_types))
    return F.lit(True) if redact_urls else kind != "URL"


def _touching(ranges: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``use(touches)``: whether a range touches any of ``ranges`` (sorted, apart), by a binary search for the last that begins before its end."""

    def search(rs: Column, starts: Column, steps: Column) -> Column:
        begun = lambda x: F.aggregate(steps, F.lit(0), lambda n, p: F.when(F.get(starts, n + p - 1) < x.end, n + p).otherwise(n))
        return use(lambda x: F.coalesce(F.get(rs, begun(x) - 1).end > x.start, F.lit(False)))

    steps = lambda rs: F.filter(F.array(*[F.lit(1 << n) for n in range(30, -1, -1)]), lambda p: p <= F.size(rs))
    return S.once(ranges, lambda rs: S.once(F.transform(rs, lambda r: r.start), lambda starts: S.once(steps(rs), lambda ps: search(rs, starts, ps))))


def matched_words(detected_blocks: DataFrame, entity_types: Sequence[str] | None = None, redact_urls: bool = False) -> DataFrame:
    """Blocks with ``hits`` (spans that touch a word) and words flagged ``matched``."""
    want = F.filter("spans", lambda s: wanted_types(s.entity_type, entity_types, redact_urls))
    out = detected_blocks.withColumn("hits", _touching(F.col("words"), lambda touches: F.filter(want, touches)))
    flag = lambda w, touches: F.struct(*[w[c].alias(c) for c in ("text", "start", "end", *BOX)], touches(w).alias("matched"))
    return out.withColumn("words", _touching(S.union(F.col("hits")), lambda touches: F.transform("words", lambda w: flag(w, touches))))


def redaction_boxes(matched: DataFrame, padding: float = X.REDACTION_PADDING) -> DataFrame:
    """One padded box for each matched word."""
    w = matched.select(*KEYS, F.explode("words").alias("w")).filter("w.matched")
    return w.select(*KEYS, F.col("w.text").alias("text"), *[(F.col(f"w.{c}") + d * padding).alias(c) for c, d in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])


def surviving_words(matched: DataFrame) -> DataFrame:
    """Words that are written again after redaction."""
    return matched.select(*KEYS, F.explode("words").alias("w")).filter("not w.matched").select(*KEYS, "w.*").drop("matched")


def entity_counts(detected_blocks: DataFrame) -> DataFrame:
    """(doc, page, entity_type, n) of all spans."""
    kinds = detected_blocks.select("doc", "page", F.explode("spans").alias("s"))
    return kinds.groupBy("doc", "page", F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


def page_maps(counts: DataFrame) -> DataFrame:
    """(doc, pages): page number from 1, as a string, to a map of type to count."""
    per = counts.groupBy("doc", "page").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("m"))
    return per.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct((F.col("page") + 1).cast("string").alias("p"), "m"))).alias("pages"))


def redact(words: DataFrame, entity_types: Sequence[str] | None = None, redact_urls: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(boxes, summary by document: pages_processed, total_spans_redacted, redacted_by_type)."""
    found = matched_words(detect(blocks(words), **options), entity_types, redact_urls)
    kinds = found.select("doc", F.explode_outer(F.transform("hits", lambda s: s.entity_type)).alias("k"))
    by = kinds.filter("k is not null").groupBy("doc", "k").count().groupBy("doc").agg(F.sum("count").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", F.col("count").cast("int"))))).alias("by"))
    n_pages = words.groupBy("doc").agg(F.countDistinct("page").alias("pages_processed"))
    summary = n_pages.join(by, "doc", "left").select("doc", "pages_processed", F.coalesce("total", F.lit(0)).alias("total_spans_redacted"), F.coalesce("by", F.create_map().cast("map<string,int>")).alias("redacted_by_type"))
    return redaction_boxes(found), summary


def _spread(low: Column, high: Column) -> Column:
    """The power of two that is no smaller than a box's extent, so that it lies in two cells of that size; boxes without a finite extent have one that makes all cells one."""
    extent = high - low
    return F.when(extent < float("inf"), F.ceil(F.log2(F.greatest(extent, F.lit(2.0**-20))))).otherwise(2000).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level))


def first_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc, page, cx, cy, run) for distinct points in a box: the smallest ``run`` of the boxes (x0, x1, y0, y1) that hold it.

    A box lies in the cells, of its own size, of a grid; a point looks once at each size that its page has.
    """
    size = [_spread(F.col("x0"), F.col("x1")).alias("lx"), _spread(F.col("y0"), F.col("y1")).alias("ly")]
    sized = boxes.filter("x0 <= x1 and y0 <= y1").select("*", *size)
    cells = lambda a, b, n: F.explode(F.sequence(_cell(F.col(a), F.col(n)), _cell(F.col(b), F.col(n))))
    placed = sized.withColumn("gx", cells("x0", "x1", "lx")).withColumn("gy", cells("y0", "y1", "ly"))
    looks = points.join(sized.select("doc", "page", "lx", "ly").distinct(), ["doc", "page"])
    looks = looks.withColumns({"gx": _cell(F.col("cx"), F.col("lx")), "gy": _cell(F.col("cy"), F.col("ly"))})
    near = looks.join(placed, ["doc", "page", "lx", "ly", "gx", "gy"]).filter("cx between x0 and x1 and cy between y0 and y1")
    return near.groupBy("doc", "page", "cx", "cy").agg(F.min("run").alias("run"))


def font_run_of_word(words: DataFrame, runs: DataFrame, tolerance: float = X.FONT_TOLERANCE) -> DataFrame:
    """Each word with the first font run (by ``run_no``) whose box, widened a little, holds its centre.

    Only the first run of equal boxes counts, and words with one centre are looked up once.
    """
    keys = ["doc", "page", "block_no", "line_no", "word_no"]
    rgb = [(F.shiftright("color", n).bitwiseAND(255) / 255.0).alias(c) for c, n in (("red", 16), ("green", 8), ("blue", 0))]
    one = F.struct("run_no", font_name(F.col("font")).alias("font"), "size", *rgb)
    box = [(F.col(c) + d * tolerance).alias(c) for c, d in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]
    boxes = runs.filter("run_no is not null").select("doc", "page", *box, one.alias("run")).groupBy("doc", "page", "x0", "y0", "x1", "y1").agg(F.min("run").alias("run"))
    centre = ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy")
    placed = words.select(*keys, *centre)
    found = first_box(placed.select("doc", "page", "cx", "cy").distinct(), boxes)
    got = placed.join(found, ["doc", "page", "cx", "cy"], "left").groupBy(*keys).agg(F.min("run").alias("run"))
    return got.select(*keys, "run.*")


def font_name(font: Column) -> Column:
    """Without the prefix of an embedded subset."""
    return F.regexp_replace(font, r"^[A-Z]{6}\+", "")


def font_alias(path: Column) -> Column:
    return F.concat(F.lit("PG"), F.substring(F.sha1(path), 1, 8))
