"""Media columns: payloads kept as images in archives and read by a custom Spark data source.

Writing: each payload is a grayscale PNG, 64 samples of 8 bits a row (lossless), stored in ZIP
archives of a bounded size under the shared folder.  A task names its archives by partition
and attempt; only those listed in the manifest, which Spark commits, are read.

Reading: ``veil_archive`` plans byte ranges over the archives of a directory; a partition reads
the members whose header lies in its range, one by one at their offsets, checks each (header,
checksum), tries a failing member again by itself, and streams batches of a bounded number of
bytes through Arrow.

Contract: a null text counts as empty; payloads are padded with zero bytes to a positive multiple
of 64; equal texts give equal media and features; ids may be null or repeat; an empty table gives
an empty result.  Ids are integers; other columns play no part.
"""

from __future__ import annotations

import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veilspark.llm.common import Scratch

WIDTH, ARCHIVE_BYTES, SPLIT_BYTES, BATCH_BYTES, TRIES = 64, 64 << 20, 16 << 20, 4 << 20, 3
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
SCHEMA = "member string, archive string, offset long, n_bytes long, payload binary, media binary, feature string, error string"


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes) -> bytes:
    """The padded payload as rows of 64 gray samples; its unpadded length as a text chunk."""
    rows = np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[int, bytes]:
    """(unpadded length, payload) of what ``encode_png`` wrote; ValueError if it is damaged."""
    if media[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, n, packed, shape = 8, None, [], None
    while at + 12 <= len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("bad chunk checksum")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            n = int(data[8:])
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0) or n is None:
        raise ValueError("unexpected PNG header")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return n, lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and an 8 by 8 average hash of the image."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    levels = np.arange(256)
    mean = float((counts * levels).sum() / len(x))
    spread = float(((counts * levels * levels).sum() / len(x) - mean * mean)) ** 0.5
    rows = len(x) // WIDTH
    cuts = np.arange(8) * rows // 8
    img = np.add.reduceat(x.reshape(rows, 8, 8).sum(axis=2, dtype=np.int64), np.minimum(cuts, rows - 1), axis=0)
    per = np.maximum(np.diff(np.r_[cuts, rows]), 1)[:, None] * 8
    small = img / per
    bits = np.packbits(small > small.mean()).tobytes().hex()
    return f"mean={mean:.4f};spread={max(spread, 0.0):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};ahash={bits}"


def _write_archives(folder: str, id_col: str, text: str):
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        tag = f"{ctx.partitionId()}-{ctx.taskAttemptId()}" if ctx else "0-0"
        made: list[tuple[str, int, int]] = []
        out = z = None
        size = members = 0

        def close():
            if z is not None:
                z.close()
                out.close()
                made.append((name, members, fs.get_file_info(f"{root}/{name}").size))

        for rb in it:
            ids = rb.column(rb.schema.get_field_index(id_col)).to_pylist()
            for i, t in zip(ids, rb.column(rb.schema.get_field_index(text)).cast(pa.large_binary())):
                media = encode_png(t.as_buffer().to_pybytes() if t.is_valid else b"")
                if z is None or size + len(media) > ARCHIVE_BYTES:
                    close()
                    name, size, members = f"part-{tag}-{len(made)}.zip", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}")
                    z = zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED)
                z.writestr(zipfile.ZipInfo(f"{'null' if i is None else i}.png"), media)
                size += len(media)
                members += 1
        close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([m[0] for m in made], pa.string()), "members": pa.array([m[1] for m in made], pa.int64()), "bytes": pa.array([m[2] for m in made], pa.int64())})

    return work


class _Sink:
    """An output stream that zipfile can write to without seeking back."""

    def __init__(self, out):
        self.out = out

    def write(self, data):
        self.out.write(data)
        return len(data)

    def flush(self):
        pass

    def tell(self):
        raise OSError("a stream")


def write_archives(scratch: Scratch, docs: DataFrame, text: str, id_col: str) -> tuple[str, str]:
    """Store every text; (folder of archives, path of the committed manifest)."""
    folder = scratch.path("archives")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text))
    scratch.table(rows.mapInArrow(_write_archives(folder, id_col, text), "archive string, members long, bytes long"), "manifest")
    return folder, scratch.path("manifest")


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.manifest = options.get("manifest")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.report = options.get("onError", "raise") == "report"

    def partitions(self):
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        if self.manifest:
            import pyarrow.parquet as pq

            mfs, mroot = pyarrow.fs.FileSystem.from_uri(self.manifest)
            t = pq.read_table(mroot, filesystem=mfs, columns=["archive", "bytes"])
            files = list(zip(t["archive"].to_pylist(), t["bytes"].to_pylist()))
        else:
            infos = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
            files = [(i.base_name, i.size) for i in infos if i.base_name.endswith(".zip")]
        parts = [Range(f"{root}/{n}", s, min(size, s + self.split)) for n, size in sorted(files) for s in range(0, size, self.split)]
        return parts or [Range("", 0, 0)]

    def read(self, part):
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        if part.archive:
            f = fs.open_input_file(part.archive)
            with zipfile.ZipFile(f) as z:
                members = [i for i in z.infolist() if part.start <= i.header_offset < part.end]
            f.close()
            f = fs.open_input_file(part.archive)
            for info in members:
                for left in reversed(range(TRIES)):
                    try:
                        media = member_at(f, info)
                        n, payload = decode_png(media)
                        rows.append((info.filename, part.archive, info.header_offset, n, payload, media, feature(payload), None))
                        break
                    except (OSError, ValueError, zlib.error, struct.error) as e:
                        if not left:
                            if not self.report:
                                raise
                            rows.append((info.filename, part.archive, info.header_offset, None, None, None, None, f"{type(e).__name__}: {e}"))
                            break
                        time.sleep(0.05)
                        f = fs.open_input_file(part.archive)
                size += len(rows[-1][4] or b"") + len(rows[-1][5] or b"")
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def member_at(f, info: zipfile.ZipInfo) -> bytes:
    """One stored member, read at its offset and checked."""
    f.seek(info.header_offset)
    head = f.read(30)
    sign, name, extra = struct.unpack("<4s22xHH", head)
    if sign != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    body = f.read(name + extra + info.file_size)[name + extra :]
    if len(body) != info.file_size or zlib.crc32(body) != info.CRC:
        raise ValueError("damaged member")
    return body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class ArchiveSource(DataSource):
    """``spark.read.format("veil_archive").option("path", folder).load()``"""

    @classmethod
    def name(cls):
        return "veil_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, manifest: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("veil_archive").option("path", folder)
    for k, v in ({"manifest": manifest} if manifest else {} | options).items():
        reader = reader.option(k, v)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store every text as media, read it back, one row per document with digests and features."""
    scratch = Scratch(docs.sparkSession, "media")
    got = read_archives(docs.sparkSession, *write_archives(scratch, docs, text, id_col))
    size = F.octet_length("payload")
    return got.select(
        F.when(F.col("member") != "null.png", F.regexp_extract("member", r"^(-?[0-9]+)\.png$", 1).try_cast("long")).alias(id_col),
        "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
