"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two grouped minima and joins; the edge list is written to the shared folder
between rounds.  A node with very many edges only ever meets a partial aggregate or a join
that adaptive execution may split, never a list in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilspark.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(low, both.a == low.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    low = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = down.join(low, down.a == low.u).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is the smallest node.

    Nodes without an edge are absent.  An empty edge list gives an empty result.
    """
    now = scratch.table(edges.filter("a is not null and b is not null and a <> b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = None
    for i in range(1, max_rounds + 1):
        new = _small_star(_large_star(now).distinct()).distinct()
        new = scratch.table(new, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = new
        got = tuple(now.agg(F.count("*"), mark).first())
        if got == before:
            break
        before = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
