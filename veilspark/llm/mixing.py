"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996), in DataFrame functions.

Documents of a source form blocks.  With a weight of n / L, block i of a source is released at
slot floor(i * L / n) and has its deadline at ceil((i + 1) * L / n); in each slot the released
block with the earliest deadline goes next.  As the weights sum to one, no deadline is missed,
so that at any slot each source has had its share to within less than one block.  Windows
repeat after L slots: one period is scheduled (a fold over L slots, whatever the table's size)
and every block's slot follows from its number.

A source that runs out leaves its later slots empty; the rest keep their order.  Every row is
kept.  Rows are numbered within (source, salt) groups of bounded size, so that a source with a
third of all rows is ranked by many tasks; rows without an id are spread by their place in the input.

L is the smallest multiple (up to ``MULTIPLES``) of ``period`` of which all weights are whole parts; if there is
none, the smallest in which every source has a block; and twice the number of sources at least, so any
number of sources is mixed.  Weights that are no whole parts of L are rounded to such (largest
remainders), and shares are kept to within one block of the rounded weights.  Only sources whose
weight is under 1 / (``MULTIPLES`` * ``period``) get more than theirs, one block in L.  The fold takes
L x sources steps in one task.

Contract: a null source is a source of its own; null and repeated ids are kept and ordered among
themselves; an empty table gives an empty result.  Target weights come from ``weights`` (source to
weight, for all sources) or are the rows of a source to the power ``alpha``.  Columns of the input stay,
but for those named as the five new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK, PERIOD, ALPHA, GROUP, MULTIPLES = 64, 1000, 0.5, 4096, 16
#: Source tables of so many rows are sent to every task; larger ones are joined as tables.
SMALL = 10_000


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def units(counts: DataFrame, weights: dict[str | None, float] | None, period: int, alpha: float) -> DataFrame:
    """(key, rows, n): each source's blocks in a period; largest remainders, at least one.

    They sum to the period's length.
    """
    if weights:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in ("" if k is None else f"={k}", float(w))])
        raw: Column = F.coalesce(F.element_at(given, F.col("key")), F.lit(0.0))
    else:
        raw = F.pow(F.col("rows").cast("double"), F.lit(alpha))
    every = Window.partitionBy()
    got = counts.withColumn("w", raw)
    got = got.withColumn("w", F.col("w") / F.sum("w").over(every))
    lengths = [period * m for m in range(1, MULTIPLES + 1)]
    off = [F.max(F.abs(F.col("w") * n - F.round(F.col("w") * n))).over(every) for n in lengths]
    full = [F.round(F.min("w").over(every) * n, 6) >= 1 for n in lengths]
    exact = F.coalesce(*[F.when((o < 1e-6) & f, n) for o, f, n in zip(off, full, lengths)])
    length = F.coalesce(exact, *[F.when(f, n) for f, n in zip(full, lengths)], F.lit(lengths[-1]))
    got = got.withColumn("length", F.greatest(length.cast("long"), 2 * F.count("*").over(every)))
    length = F.col("length")
    tight = F.round(F.min("w").over(every) * length, 6) < 1
    got = got.withColumn("small", tight & (F.round(F.col("w") * length, 6) < 2))  # these get one block each
    rest = length - F.count_if("small").over(every)
    share = F.col("w") / F.sum(F.when(~F.col("small"), F.col("w"))).over(every) * rest
    got = got.withColumn("exact", F.when(F.col("small"), 1.0).otherwise(F.round(share, 6))).withColumn("low", F.floor("exact"))
    left = length - F.sum("low").over(every)
    order = F.row_number().over(every.orderBy("small", F.col("low") - F.col("exact"), "key"))
    return got.select("key", "rows", (F.col("low") + (order <= left).cast("long")).cast("int").alias("n"))


def period_schedule(unit: DataFrame) -> DataFrame:
    """(key, n, length, i, t): the i-th block of a source within a period, the sum of all n, goes at slot t."""
    table = unit.agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("s"), F.sum("n").alias("length"))
    length = F.col("length")

    def step(acc: Column, t: Column) -> Column:
        def rank(x: Column, i: Column) -> Column:
            done, n = F.get(acc.done, i), x.n
            open_ = (done < n) & (F.floor(done * length / n) <= t)
            return F.when(open_, F.struct(F.ceil((done + 1) * length / n).alias("d"), i.alias("i")))

        best = F.array_min(F.transform(F.col("s"), rank)).i

        def taken(b: Column) -> Column:
            return F.struct(F.transform(acc.done, lambda d, i: F.when(i == b, d + 1).otherwise(d)).alias("done"), F.concat(acc.out, F.array(b)).alias("out"))

        return F.get(F.transform(F.array(best), taken), F.lit(0))  # a lambda, so that ``best`` is computed once

    start = F.struct(F.transform("s", lambda x: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("out"))
    run = F.aggregate(F.sequence(F.lit(0), (length - 1).cast("int")), start, step, lambda a: a.out)
    slots = table.filter(F.size("s") > 0).select("s", "length", F.posexplode(run).alias("t", "which"))
    slots = slots.select(F.get("s", F.col("which")).alias("x"), "length", "t")
    nth = F.row_number().over(Window.partitionBy("x.key").orderBy("t")) - 1
    return slots.select(F.col("x.key").alias("key"), F.col("x.n").alias("n"), "length", nth.alias("i"), "t")


def schedule(docs: DataFrame, source: str = "source", id_col: str = "doc_id", weights: dict[str | None, float] | None = None,
             block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA, group: int = GROUP) -> DataFrame:
    """The table with ``block_no``, ``block_seq``, ``release_slot``, ``deadline_slot`` and ``mix_slot``.

    Sorted by (mix_slot, block_seq) it is the mixture.  Columns of these names are replaced.
    """
    new = ("block_no", "block_seq", "release_slot", "deadline_slot", "mix_slot")
    kept = [c for c in docs.columns if c not in new]
    key = _key(F.col(source))
    counts = docs.groupBy(key.alias("key")).agg(F.count("*").alias("rows"))
    unit = units(counts, weights, period, alpha)
    slots = period_schedule(unit)
    number = F.coalesce(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long"), F.monotonically_increasing_id())
    near = F.broadcast if counts.limit(SMALL + 1).count() <= SMALL else lambda t: t
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(id_col).alias("id"), key.alias("key"), number.alias("h"))
    per = counts.select("key", F.ceil(F.col("rows") / group).cast("long").alias("salts"))
    rows = rows.join(near(per), "key").withColumn("salt", F.pmod("h", "salts"))
    sizes = rows.groupBy("key", "salt").agg(F.ceil(F.count("*") / block).alias("blocks"))
    before = F.sum("blocks").over(Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("key", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("key", "salt").orderBy("id", "h")) - 1
    rows = rows.withColumn("nth", nth).join(bases, ["key", "salt"])
    rows = rows.withColumn("b", F.col("base") + F.floor(F.col("nth") / block))
    first = slots.select("key", "n", "length").distinct()
    rows = rows.join(near(first), "key").withColumn("i", F.pmod(F.col("b"), F.col("n")).cast("int"))
    rows = rows.join(near(slots.drop("n", "length")), ["key", "i"])
    length = F.col("length")
    return rows.select(
        "row.*", F.col("b").cast("long").alias("block_no"), F.pmod("nth", F.lit(block)).cast("long").alias("block_seq"),
        F.floor(F.col("b") * length / F.col("n")).alias("release_slot"), F.ceil((F.col("b") + 1) * length / F.col("n")).alias("deadline_slot"),
        (F.floor(F.col("b") / F.col("n")) * length + F.col("t")).cast("long").alias("mix_slot"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The same rows and columns in mixed order: partitions are ranges of slots, sorted within."""
    out = schedule(docs, **options)
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return out.repartitionByRange(int(n), "mix_slot", "block_seq").sortWithinPartitions("mix_slot", "block_seq").select(*docs.columns)
