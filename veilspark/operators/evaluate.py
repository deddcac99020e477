"""Detection quality: additive counters by group, rates, misses, snapshots and their comparison.

Examples are rows (id, domain, text, entities array<start,end,type>, pred array<start,end,entity_type>);
null arrays are empty.  Each example is measured within its row, so that only counters are shuffled.
"""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.config import IncomparableSnapshotsError
from veilspark.functions import fixed as X, spans as S

COUNTERS = [
    "examples", "gold_entities", "gold_chars", "covered_chars", "strict_hits", "relaxed_hits", "type_evaluated", "type_correct",
    "pred_spans", "pred_chars", "fp_chars", "strict_pred_hits", "relaxed_pred_hits", "clean_examples", "clean_examples_with_fp", "fp_spans_on_clean",
]
#: rate: (numerator, denominator, higher is better)
RATES = {
    "leak_recall": ("covered_chars", "gold_chars", True),
    "strict_recall": ("strict_hits", "gold_entities", True),
    "relaxed_recall": ("relaxed_hits", "gold_entities", True),
    "type_accuracy": ("type_correct", "type_evaluated", True),
    "strict_precision": ("strict_pred_hits", "pred_spans", True),
    "relaxed_precision": ("relaxed_pred_hits", "pred_spans", True),
    "fp_char_rate": ("fp_chars", "pred_chars", False),
}
#: The rates that a section of a snapshot is compared by.
SECTION_RATES = {
    "overall": [*RATES],
    "by_group": ["leak_recall", "relaxed_recall"],
    "by_type": ["leak_recall", "strict_recall", "type_accuracy"],
    "by_pred_type": ["strict_precision", "fp_char_rate"],
    "by_domain": ["leak_recall", "fp_char_rate"],
}


def mapped_type(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in X.BENCHMARK_TYPES.items() for x in kv]), kind)


def _counted(**values: Column) -> Column:
    return F.struct(*[F.coalesce(values.get(c, F.lit(0)).cast("long"), F.lit(0)).alias(c) for c in COUNTERS])


def _common(a: Column, b: Column) -> Column:
    return F.least(a.end, b.end) - F.greatest(a.start, b.start)


def gold_side(e: Column, pred: Column, pred_union: Column) -> Column:
    """Counters of one gold entity; its type is judged on the span of largest overlap, the first of equals."""
    want = mapped_type(e.type)
    near = F.filter(pred, lambda p: _common(e, p) > 0)
    strict = F.exists(near, lambda p: (p.start == e.start) & (p.end == e.end) & (p.entity_type == want))
    ranked = F.transform(near, lambda p, i: F.struct(_common(e, p).alias("n"), (-i).alias("i"), p.entity_type.alias("t")))
    best, hit = F.array_max(ranked).t, F.size(near) > 0
    return _counted(
        gold_entities=F.lit(1), gold_chars=e.end - e.start, covered_chars=S.overlap(e.start, e.end, pred_union),
        strict_hits=F.coalesce(strict, F.lit(False)).cast("int"), relaxed_hits=hit.cast("int"),
        type_evaluated=(hit & want.isNotNull()).cast("int"), type_correct=F.coalesce(hit & (best == want), F.lit(False)).cast("int"),
    )


def pred_side(p: Column, gold: Column, gold_union: Column) -> Column:
    size = p.end - p.start
    strict = F.exists(gold, lambda e: (e.start == p.start) & (e.end == p.end) & (e.end > e.start) & (mapped_type(e.type) == p.entity_type))
    return _counted(
        pred_spans=F.lit(1), pred_chars=size, fp_chars=size - S.overlap(p.start, p.end, gold_union),
        relaxed_pred_hits=F.exists(gold, lambda e: _common(e, p) > 0).cast("int"), strict_pred_hits=F.coalesce(strict, F.lit(False)).cast("int"),
    )


def counters(examples: DataFrame) -> DataFrame:
    """(section, key, counters): overall, by_domain, by_type, by_group, by_pred_type in one pass and one shuffle."""
    rows = examples.select(
        F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,type:string>>")).alias("g"),
        F.coalesce("pred", F.array().cast("array<struct<start:int,end:int,entity_type:string>>")).alias("p"),
    )
    rows = rows.withColumn("gu", S.union(F.col("g"))).withColumn("pu", S.union(F.col("p")))
    g, p = F.col("g"), F.col("p")
    clean = F.size(g) == 0
    whole = _counted(examples=F.lit(1), clean_examples=clean.cast("int"), clean_examples_with_fp=(clean & (F.size(p) > 0)).cast("int"), fp_spans_on_clean=F.when(clean, F.size(p)).otherwise(0))

    def entry(kind: Column, pred_kind: Column, c: Column) -> Column:
        return F.struct(kind.cast("string").alias("t"), pred_kind.cast("string").alias("k"), c.alias("c"))

    null = F.lit(None)
    every = F.concat(
        F.array(entry(null, null, whole)),
        F.transform(g, lambda e: entry(e.type, null, gold_side(e, p, F.col("pu")))),
        F.transform(p, lambda s: entry(null, s.entity_type, pred_side(s, g, F.col("gu")))),
    )
    rows = rows.select("domain", F.explode(every).alias("x")).select("domain", "x.t", "x.k", "x.c.*")
    group = F.when(F.col("t").isNotNull(), F.when(F.col("t").isin(X.UNSUPPORTED_TYPES), "unsupported").otherwise("supported"))
    fine = rows.withColumn("grp", group).groupBy("domain", "t", "k", "grp").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    keys = F.array(*[F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in (("overall", F.lit("all")), ("by_domain", F.col("domain")), ("by_type", F.col("t")), ("by_group", F.col("grp")), ("by_pred_type", F.col("k")))])
    long = fine.select(F.explode(F.filter(keys, lambda k: k.key.isNotNull())).alias("s"), *COUNTERS)
    return long.groupBy("s.section", "s.key").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def with_rates(counted: DataFrame) -> DataFrame:
    """Adds the seven rates, null where nothing is counted."""
    return counted.select("*", *[F.when(F.col(d) != 0, F.col(n) / F.col(d)).alias(r) for r, (n, d, _) in RATES.items()])


def misses(examples: DataFrame) -> DataFrame:
    """Gold entities that no span touches: (id, type, start, end), never text."""
    rows = examples.select("id", F.coalesce("pred", F.array().cast("array<struct<start:int,end:int,entity_type:string>>")).alias("p"), F.explode("entities").alias("e"))
    return rows.filter(~F.exists("p", lambda s: _common(F.col("e"), s) > 0)).select("id", "e.type", "e.start", "e.end")


def predict(examples: DataFrame, **options) -> DataFrame:
    """Run detection on the examples: adds ``pred``."""
    from veilspark.operators.detect import detect

    found = detect(examples, **options)
    return found.withColumn("pred", F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type")))).drop("spans", "layer_stats")


def git_state(folder: str) -> dict:
    """The commit of a working copy and whether it has changes; None where there is no git or no copy."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, check=True, timeout=30).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    status = git("status", "--porcelain")
    return {"git_commit": git("rev-parse", "HEAD"), "git_dirty": None if status is None else bool(status)}


def build_snapshot(metrics: DataFrame, meta: dict) -> dict:
    """Metrics (a few hundred rows at most) and metadata as one document; no text of examples."""
    out: dict = {s: {} for s in SECTION_RATES}
    for r in metrics.orderBy("section", "key").collect():
        out[r.section][r.key] = {c: r[c] for c in COUNTERS} | {"rates": {k: r[k] for k in RATES}}
    return {"format_version": 1, "meta": meta, "metrics": out}


def snapshot_rows(spark, snapshot: dict) -> DataFrame:
    """(section, key, metric, rate, detail) of a snapshot."""
    rows = []
    for section, rates in SECTION_RATES.items():
        for key, group in snapshot["metrics"].get(section, {}).items():
            for m in rates:
                n, d, _ = RATES[m]
                v = group["rates"][m]
                rows.append((section, key, m, None if v is None else float(v), f"{group[n]}/{group[d]}"))
    return spark.createDataFrame(rows, "section string, key string, metric string, rate double, detail string")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer join of two snapshots' rows: before, after, delta and verdict."""
    b = before.select("section", "key", "metric", F.col("rate").alias("before"), F.col("detail").alias("detail_before"))
    a = after.select("section", "key", "metric", F.col("rate").alias("after"), F.col("detail").alias("detail_after"))
    delta = F.col("after") - F.col("before")
    up = F.col("metric") != "fp_char_rate"
    verdict = F.when(delta.isNull() | (F.abs(delta) < 1e-9), "").when((delta > 0) == up, "better").otherwise("worse")
    return (
        b.join(a, ["section", "key", "metric"], "full_outer").filter("before is not null or after is not null")
        .select("section", "key", "metric", "before", "after", F.coalesce("detail_before", F.lit("")).alias("detail_before"), F.coalesce("detail_after", F.lit("")).alias("detail_after"), delta.alias("delta"), verdict.alias("verdict"))
    )


def compare_snapshots(spark, before: dict, after: dict) -> tuple[DataFrame, list[str]]:
    """(rows, warnings); snapshots of other data are refused."""
    b, a = before["meta"], after["meta"]
    for k in ("dataset_revision", "dataset_config"):
        if b.get(k) != a.get(k):
            raise IncomparableSnapshotsError(f"{k}: {b.get(k)!r} and {a.get(k)!r}")
    warnings = [f"{k}: {b.get(k)!r} and {a.get(k)!r}" for k in ("min_confidence", "natasha_available", "example_count") if b.get(k) != a.get(k)]
    return compare(snapshot_rows(spark, before), snapshot_rows(spark, after)), warnings


def format_rows(rows: DataFrame) -> DataFrame:
    """Rates as percentages with their counts, for printing."""
    pct = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%6.2f%%", F.col(c) * 100)).otherwise("-")
    return rows.orderBy("section", "key", "metric").select("section", "key", "metric", *[F.concat(pct(c), F.lit(" "), d).alias(c) for c, d in (("before", "detail_before"), ("after", "detail_after"))], "verdict")


def write_snapshot(snapshot: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(snapshot, ensure_ascii=False, indent=2) + "\n")


def read_snapshot(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
