"""Sharding: laws of the contract, stored map, rebalancing."""

import zlib

from pyspark.sql import functions as F

from veilspark.llm import sharding


def test_assign(docs, doc_rows):
    got = sharding.assign(docs, shards=4).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in doc_rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    for s in range(4):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_bytes_near_equal(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    sums = [r.s for r in sharding.assign(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.01 * max(sums)


def test_empty(no_docs):
    assert sharding.assign(no_docs).count() == 0


def test_rebalance_moves_little():
    load = {v: 1 + v % 7 for v in range(512)}
    first = sharding.plan(load, 4, 512)
    assert sharding.rebalance(load, first, 4) == first
    grown = sharding.rebalance(load, first, 5)
    moved = [v for v in load if grown[v] != first[v]]
    assert all(grown[v] == 4 for v in moved)
    sums = [sum(load[v] for v in load if grown[v] == s) for s in range(5)]
    assert max(sums) - min(sums) <= 0.05 * max(sums)
    shrunk = sharding.rebalance(load, grown, 3)
    assert set(shrunk.values()) == {0, 1, 2}


def plain_plan(rows, shards, virtual):
    """(id, shard, slot) of every row, by the rules alone."""
    import struct

    import xxhash

    slots = {}
    for i, t in rows:
        b = (t or "").encode()
        crc = zlib.crc32(b)
        h = xxhash.xxh64_intdigest(struct.pack("<q", crc), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        slots.setdefault((h - (1 << 64) if h >> 63 else h) % virtual, []).append((i, crc, len(b) + 1))
    total, where = [0] * shards, {}
    for v in sorted(range(virtual), key=lambda v: (-sum(x[2] for x in slots.get(v, [])), v)):
        where[v] = min(range(shards), key=lambda s: (total[s], s))
        total[where[v]] += sum(x[2] for x in slots.get(v, []))
    end, out = [0] * shards, []
    for v in range(virtual):
        for i, _, _ in sorted(slots.get(v, [])):
            out.append((i, where[v], end[where[v]]))
            end[where[v]] += 1
    return sorted(out)


def test_whole_plan_against_plain_python(spark, doc_rows):
    rows = [(i, t) for i, t, _ in doc_rows if i is not None]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=3, virtual=16).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == plain_plan(rows, 3, 16)


def test_stored_map_is_loaded_edited_and_versioned(spark, tmp_path):
    def table(n, size):
        return spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (size + F.col("id") % 50).cast("int")).alias("text"))

    store = f"file://{tmp_path}/map"
    one = sharding.assign(table(3000, 10), store=store)
    assert {r.map_version for r in one.collect()} == {1}
    same = sharding.assign(table(3000, 10), store=store)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, one.collect()))
    more = sharding.assign(table(9000, 10), shards=9, store=store).collect()
    assert {r.map_version for r in more} == {2} and {r.shard for r in more} == set(range(9))
    (v1, a), (v2, b) = (1, dict(spark.read.parquet(f"{store}/version=000001").collect())), sharding.load_map(spark, store)
    assert (v1, v2) == (1, 2) and sum(a[v] != b[v] for v in a) < len(a) / 3
    sums = [sum(r["size"] for r in more if r.shard == s) for s in range(9)]
    assert max(sums) - min(sums) < 0.05 * max(sums)


def test_rows_without_ids_and_clashing_columns(spark):
    df = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("q").alias("v"), F.lit(1).alias("shard"))
    got = sharding.assign(df.repartition(4)).collect()
    assert len({r.virtual_slot for r in got}) > 50
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
