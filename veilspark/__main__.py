"""Command line: ``python -m veilspark process|detect|run|show|compare``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from veilspark.config import EngineError, EngineConfig, threshold
from veilspark.operators import evaluate
from veilspark.plans.engine import Engine
from veilspark.sources import files

PREVIEW = 500


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("process", help="mask a text (arguments or standard input), ask, restore")
    one.add_argument("text", nargs="*")
    one.add_argument("--system")
    found = sub.add_parser("detect", help="counts by type of whole text files")
    found.add_argument("paths", nargs="+")
    run = sub.add_parser("run", help="measure a benchmark, write a snapshot")
    run.add_argument("benchmark")
    run.add_argument("--output", required=True)
    run.add_argument("--misses", help="folder for entities that were not found (no text)")
    run.add_argument("--min-confidence", type=float)
    run.add_argument("--revision", default="local")
    run.add_argument("--config", default="default")
    show = sub.add_parser("show", help="print a snapshot")
    show.add_argument("snapshot")
    both = sub.add_parser("compare", help="print what differs between two snapshots")
    both.add_argument("before")
    both.add_argument("after")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 2 for errors of the engine."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("veilspark").getOrCreate()
    try:
        return _COMMANDS[args.command](spark, args)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _process(spark: SparkSession, args) -> int:
    text = " ".join(args.text) if args.text else sys.stdin.read().strip()
    out = Engine(spark).process_text(text, system=args.system)
    for k in ("anonymized_text", "llm_response"):
        print(f"{k}: {out[k][:PREVIEW]}")
    print(json.dumps(out["stats"], ensure_ascii=False))
    return 0


def _detect(spark: SparkSession, args) -> int:
    Engine(spark).detect_files(*args.paths).show(truncate=False)
    return 0


def _run(spark: SparkSession, args) -> int:
    least = threshold(args.min_confidence, EngineConfig.from_spark(spark))
    rows = evaluate.predict(files.examples(spark, args.benchmark), min_confidence=least)
    meta = {"dataset_revision": args.revision, "dataset_config": args.config, "example_count": rows.count(), "min_confidence": least, "natasha_available": False}
    snapshot = evaluate.build_snapshot(evaluate.with_rates(evaluate.counters(rows)), meta)
    evaluate.write_snapshot(snapshot, args.output)
    if args.misses:
        files.write_misses(evaluate.misses(rows), args.misses)
    return _print(snapshot)


def _print(snapshot: dict) -> int:
    print(json.dumps(snapshot["meta"], ensure_ascii=False))
    for section, rates in evaluate.SECTION_RATES.items():
        for key, group in sorted(snapshot["metrics"].get(section, {}).items()):
            got = {m: group["rates"][m] for m in rates}
            print(section, key, *[f"{m}={'-' if v is None else f'{100 * v:.2f}%'}" for m, v in got.items()])
    return 0


def _show(spark: SparkSession, args) -> int:
    return _print(evaluate.read_snapshot(args.snapshot))


def _compare(spark: SparkSession, args) -> int:
    rows, warnings = evaluate.compare_snapshots(spark, *map(evaluate.read_snapshot, (args.before, args.after)))
    for w in warnings:
        print(f"warning: {w}")
    got = evaluate.format_rows(rows).collect()  # a few hundred rows at most
    for r in got:
        print(r.section, r.key, r.metric, r.before, "->", r.after, r.verdict)
    print({v: sum(r.verdict == v for r in got) for v in ("better", "worse")})
    return 0


_COMMANDS = {"process": _process, "detect": _detect, "run": _run, "show": _show, "compare": _compare}


def default_output(folder: str, version: str, commit: str, config: str) -> Path:
    """``<version>-<first ten of the commit>-<config>.json``"""
    return Path(folder) / f"{version}-{commit[:10]}-{config}.json"


if __name__ == "__main__":
    sys.exit(main())
