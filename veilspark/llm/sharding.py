"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into thousands of virtual slots, whose number never changes; bytes and rows are
summed by slot; a map, one row for each virtual slot, sends slots to shards so that bytes are
near equal.  The map is stored as a table with a version.  Rebalancing edits it: it moves as
few bytes as it can and writes the next version; records never hash anew.

With ``store`` the map lives in that folder, one subfolder for each version: the last version is
loaded, edited for the loads of the table at hand and stored as the next one if anything moved.

A record's place within its shard (``slot``, gapless from 0) is its rank in its virtual slot
plus the rows of the shard's earlier virtual slots, so no task ever ranks a whole shard.

Contract: a record's size is the UTF-8 bytes of its text (null: none) plus 1.  Rows with a null
id are spread by their place in the input, equal rows lie side by side, an empty table gives an
empty result.  Ids are integers; other columns play no part.  Only the map (``virtual`` rows, a fixed
number) visits the driver or is broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veilspark.llm.common import Scratch, exists, shared_dir

VIRTUAL, SHARDS = 4096, 8


def sized(docs: DataFrame, text: str, id_col: str, virtual: int) -> DataFrame:
    """(id, size, text_crc32, v): v is the virtual slot."""
    crc = F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    return rows.withColumn("v", F.pmod(F.xxhash64(F.coalesce(id_col, F.monotonically_increasing_id()), "text_crc32"), F.lit(virtual)).cast("int"))


def loads(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has any."""
    return rows.groupBy("v").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def plan(load: dict[int, int], shards: int, virtual: int = VIRTUAL) -> dict[int, int]:
    """First map: the heaviest slot first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for v in sorted(range(virtual), key=lambda v: (-load.get(v, 0), v)):
        got, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (got + load.get(v, 0), s))
    return out


def rebalance(load: dict[int, int], slot_map: dict[int, int], shards: int, slack: float = 0.01) -> dict[int, int]:
    """Edit a map for new loads or another number of shards.

    Slots of shards that no longer exist move, and others only from shards over the mean to the
    lightest one, the heaviest slot that fits first, until all lie within ``slack`` of the mean
    or no move helps.
    """
    new = dict(slot_map)
    total = [0] * shards
    homeless = []
    for v, s in new.items():
        if s < shards:
            total[s] += load.get(v, 0)
        else:
            homeless.append(v)
    for v in sorted(homeless, key=lambda v: -load.get(v, 0)):
        s = min(range(shards), key=total.__getitem__)
        new[v], total[s] = s, total[s] + load.get(v, 0)
    mean = sum(total) / shards
    for s in sorted(range(shards), key=lambda s: -total[s]):
        for v in sorted((v for v in new if new[v] == s), key=lambda v: -load.get(v, 0)):
            if total[s] <= mean * (1 + slack):
                break
            to, x = min(range(shards), key=total.__getitem__), load.get(v, 0)
            if x and total[to] + x <= max(mean * (1 + slack), total[s] - x):
                new[v], total[s], total[to] = to, total[s] - x, total[to] + x
    return new


def load_map(spark: SparkSession, store: str) -> tuple[int, dict[int, int]]:
    """The last version in a store and its map; (0, {}) if there is none."""
    last = 0
    while exists(spark, f"{store}/version={last + 1:06}/_SUCCESS"):
        last += 1
    if not last:
        return 0, {}
    rows = spark.read.schema("v int, shard int").parquet(f"{store}/version={last:06}").collect()  # a row for each virtual slot
    return last, {r.v: r.shard for r in rows}


def save_map(spark: SparkSession, store: str, version: int, slot_map: dict[int, int]) -> None:
    """Write a version; one that is there already is never overwritten."""
    spark.createDataFrame(sorted(slot_map.items()), "v int, shard int").coalesce(1).write.parquet(f"{store}/version={version:06}")


def current_map(spark: SparkSession, store: str, load: dict[int, int], shards: int, virtual: int) -> tuple[int, dict[int, int]]:
    """The map for these loads: the last version, edited where it has to be, or the first."""
    last, old = load_map(spark, store)
    if old and len(old) != virtual:
        raise ValueError(f"the map in {store} has {len(old)} virtual slots, not {virtual}")
    new = rebalance(load, old, shards) if old else plan(load, shards, virtual)
    if new != old:
        last += 1
        save_map(spark, store, last, new)
    return last, new


def map_table(spark: SparkSession, slot_map: dict[int, int], rows: dict[int, int]) -> DataFrame:
    """(v, shard, base): where a slot's rows begin within its shard."""
    end: dict[int, int] = {}
    out = []
    for v, s in sorted(slot_map.items()):
        out.append((v, s, end.get(s, 0)))
        end[s] = end.get(s, 0) + rows.get(v, 0)
    return spark.createDataFrame(out, "v int, shard int, base long")


def place(rows: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """Join records with a stored map."""
    here: Column = F.row_number().over(Window.partitionBy("v").orderBy(id_col, "text_crc32", "size"))
    ranked = rows.withColumn("rank", here - 1)
    placed = ranked.join(F.broadcast(table.select("v", "shard", "base")), "v")
    return placed.withColumn("slot", F.col("base") + F.col("rank"))


def assign(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shards: int = SHARDS, virtual: int = VIRTUAL, store: str | None = None) -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.table(sized(docs, text, id_col, virtual), "sized")
    load = {r.v: (r.bytes, r.rows) for r in loads(rows).collect()}  # at most ``virtual`` rows
    version, slot_map = current_map(spark, store or scratch.path("slot_map"), {v: b for v, (b, _) in load.items()}, shards, virtual)
    return place(rows, map_table(spark, slot_map, {v: n for v, (_, n) in load.items()}), id_col).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("v").alias("virtual_slot"), F.lit(version).alias("map_version"),
    )


def store_of(spark: SparkSession, name: str) -> str:
    """The folder of a named map under the shared folder."""
    return f"{shared_dir(spark)}/slot_maps/{name}"
