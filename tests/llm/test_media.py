"""Media columns: lossless round trip, byte ranges, damaged members."""

import hashlib
import zlib

import pyarrow.fs
import pytest

from veilspark.llm import media
from veilspark.llm.common import Scratch


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 200_000])
def test_png_round_trip(n):
    data = bytes(i * 7 % 256 for i in range(n))
    got_n, payload = media.decode_png(media.encode_png(data))
    assert got_n == n and payload[:n] == data and len(payload) % 64 == 0 and len(payload) >= 64
    assert not any(payload[n:])


def test_digests(docs, doc_rows):
    got = sorted(map(tuple, media.digests(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256").collect()), key=str)
    want = []
    for i, t, _ in doc_rows:
        b = (t or "").encode()
        p, m = media.pad(b), media.encode_png(b)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()))
    assert got == sorted(want, key=str)


def test_ranges_read_each_member_once(spark, docs, doc_rows):
    s = Scratch(spark, "t")
    folder, manifest = media.write_archives(s, docs, "text", "doc_id")
    for split in (200, 5000):
        got = media.read_archives(spark, folder, manifest, splitBytes=str(split))
        assert got.rdd.getNumPartitions() > 3
        assert got.count() == len(doc_rows)
    assert media.read_archives(spark, folder).count() == len(doc_rows)


def test_damaged_member_is_reported_alone(spark, docs, doc_rows):
    s = Scratch(spark, "t")
    folder, manifest = media.write_archives(s, docs, "text", "doc_id")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    name = fs.get_file_info(pyarrow.fs.FileSelector(root))[0].path
    data = bytearray(fs.open_input_file(name).read())
    data[60] ^= 255
    with fs.open_output_stream(name) as f:
        f.write(bytes(data))
    got = media.read_archives(spark, folder, manifest, onError="report")
    assert got.filter("error is not null").count() == 1 and got.count() == len(doc_rows)
    with pytest.raises(Exception):
        media.read_archives(spark, folder, manifest).collect()


def test_empty(no_docs):
    assert media.digests(no_docs).count() == 0


def plain_feature(payload):
    import math

    n, rows = len(payload), len(payload) // 64
    mean = sum(payload) / n
    spread = math.sqrt(max(0.0, sum(x * x for x in payload) / n - mean * mean))
    entropy = -sum(c / n * math.log2(c / n) for c in (payload.count(v) for v in set(payload)))
    cells = []
    for i in range(8):
        lo = i * rows // 8
        hi = max((i + 1) * rows // 8, lo + 1)
        for j in range(8):
            x = [payload[64 * r + 8 * j + k] for r in range(lo, hi) for k in range(8)]
            cells.append(sum(x) / len(x))
    middle = sum(cells) / 64
    return mean, spread, entropy, [c > middle + 1e-9 for c in cells]


@pytest.mark.parametrize("n", [0, 5, 64, 65, 640, 5000])
def test_feature(n):
    payload = media.pad(bytes((i * i * 31 + i // 64 * 7) % 251 for i in range(n)))
    got = dict(x.split("=") for x in media.feature(payload).split(";"))
    *numbers, bits = plain_feature(payload)
    for k, want in zip(("mean", "spread", "entropy"), numbers):
        assert abs(float(got[k]) - want) < 2e-4
    assert [b == "1" for b in f"{int(got['ahash'], 16):064b}"] == bits


def test_a_very_long_text_and_clashing_columns(spark):
    text = "naïve " * 200_000
    df = spark.createDataFrame([(4, text, "x"), (None, None, "y")], "doc_id long, text string, member string")
    got = {r.doc_id: r for r in media.digests(df).collect()}
    assert got[4].n_bytes == len(text.encode()) and got[None].payload_bytes == 64
