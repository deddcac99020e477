"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

All of it is DataFrame functions.  Trees are grown by histograms: features fall into fixed bins,
each level of a tree is one grouped sum of gradients by (node, feature, bin), whose size is
fixed, and the finished trees are a column expression that scores every URL in the scan's own
stage.  Labelled URLs are those whose last number is an id of ``labels``; training reads at most
``max_labels`` of them, those with the smallest hash (rows that tie are equal).

Rules: ``host/path``; a rule fits its host and all subdomains if the URL's path starts with the
rule's path; the longest rule wins.

Contract: a null URL or one without ``://`` has an empty host and path and goes to the trees;
without labelled URLs every score is the prior 0 (allow); an empty table gives an empty result.
Ids may be null or repeat; columns of the input stay, but for those named as the new ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.llm.common import Scratch

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ROUNDS, DEPTH, RATE, MAX_LABELS, SUFFIXES, LEAF = 10, 2, 0.3, 10_000, 64, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Upper bounds of the bins of each lexical feature.
BINS: dict[str, list[float]] = {
    "length": [20, 30, 35, 40, 45, 50, 60, 80, 120],
    "depth": [0, 1, 2, 3, 4, 6],
    "digit_ratio": [0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5],
    "entropy": [2.5, 3.0, 3.5, 3.75, 4.0, 4.25, 4.5, 5.0],
    "params": [0, 1, 2, 3, 5],
    "host_labels": [1, 2, 3, 4, 5],
    "host_length": [8, 12, 16, 20, 24, 30],
    "suffix_rate": [0.5, 0.6, 0.7, 0.75, 0.8, 0.82, 0.84, 0.86, 0.88, 0.9, 0.95],
}


def host_path(url: Column) -> tuple[Column, Column]:
    got = [F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(got[0], _UPPER, _LOWER), got[1]


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: len(x[1])):
        name, _, rest = r.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def features(urls: DataFrame, url: str) -> DataFrame:
    """Adds host, path and the lexical features."""
    host, path = host_path(F.col(url))
    text = F.coalesce(F.col(url), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c))) / size
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    df = urls.withColumns({"host": host, "path": path})
    return df.withColumns({
        "length": F.length(text).cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / size,
        "entropy": entropy,
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
        "host_labels": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))).cast("double"),
        "host_length": F.length("host").cast("double"),
        "suffix": F.pmod(F.xxhash64(F.element_at(F.split("host", r"\."), -1), F.regexp_extract("path", r"^/([^/]*)/", 1)), F.lit(SUFFIXES)).cast("int"),
    })


@dataclass(frozen=True)
class Model:
    """Suffix statistics and trees; a tree is (feature, bin, left, right) or a leaf value."""

    prior: float
    suffixes: dict[int, float]
    trees: list

    def binned(self, df: DataFrame) -> DataFrame:
        if self.suffixes:
            table = F.create_map(*[F.lit(x) for k, v in sorted(self.suffixes.items()) for x in (k, v)])
            df = df.withColumn("suffix_rate", F.coalesce(F.element_at(table, F.col("suffix")), F.lit(self.prior)))
        else:
            df = df.withColumn("suffix_rate", F.lit(self.prior))
        return df.withColumns({f"b_{k}": sum((F.col(k) > b).cast("int") for b in bs) for k, bs in BINS.items()})

    def score(self) -> Column:
        """Log odds of allow."""
        p = min(max(self.prior, 1e-6), 1 - 1e-6)
        return sum((_walk(t) for t in self.trees), F.lit(math.log(p / (1 - p))))


def _walk(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, cut, left, right = tree
    return F.when(F.col(f"b_{name}") <= cut, _walk(left)).otherwise(_walk(right))


def _node(tree, at: int = 1) -> Column:
    """Which leaf of an unfinished tree a row is in."""
    if not isinstance(tree, tuple):
        return F.lit(at)
    name, cut, left, right = tree
    return F.when(F.col(f"b_{name}") <= cut, _node(left, 2 * at)).otherwise(_node(right, 2 * at + 1))


def _grown(tree, splits: dict[int, tuple], at: int = 1):
    if isinstance(tree, tuple):
        return (*tree[:2], _grown(tree[2], splits, 2 * at), _grown(tree[3], splits, 2 * at + 1))
    return splits.get(at, tree)


def train(scratch: Scratch, labelled: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, max_labels: int = MAX_LABELS) -> Model:
    """Fit on rows with ``features`` and ``y`` (1 allow, 0 block), ``max_labels`` of them at most."""
    some = labelled.orderBy(F.xxhash64("url"), "url", "y").limit(max_labels)
    some = scratch.table(some.select("suffix", "y", *[k for k in BINS if k != "suffix_rate"]), "labelled")
    by = {r.suffix: (r.n, r.s) for r in some.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}
    n = sum(x[0] for x in by.values())
    if not n:
        return Model(0.5, {}, [])
    prior = sum(x[1] for x in by.values()) / n
    model = Model(prior, {k: (s + 20 * prior) / (c + 20) for k, (c, s) in by.items()}, [])
    data = scratch.table(model.binned(some).select("y", *[f"b_{k}" for k in BINS]), "binned")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"b_{k}").alias("b")) for k in BINS])).alias("c")
    for _ in range(rounds):
        tree = 0.0
        p = 1 / (1 + F.exp(-model.score()))
        for _ in range(depth):
            rows = data.select(_node(tree).alias("node"), (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), cells)
            sums = rows.groupBy("node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            tree = _grown(tree, _splits(sums, rate))
        model.trees.append(tree)
    return model


def _splits(sums, rate: float) -> dict[int, tuple]:
    """The best cut of each node, with leaf values, from its histogram."""
    best: dict[int, tuple[float, tuple]] = {}
    for node in sorted({r.node for r in sums}):
        for k, bs in BINS.items():
            cells = {r.b: (r.g, r.h) for r in sums if r.node == node and r.f == k}
            gs, hs = sum(x[0] for x in cells.values()), sum(x[1] for x in cells.values())
            g = h = 0.0
            for cut in range(len(bs)):
                dg, dh = cells.get(cut, (0.0, 0.0))
                g, h = g + dg, h + dh
                if h < LEAF or hs - h < LEAF:
                    continue
                gain = g * g / (h + 1) + (gs - g) ** 2 / (hs - h + 1) - gs * gs / (hs + 1)
                if gain > 1e-9 and gain > best.get(node, (0.0,))[0]:
                    best[node] = gain, (k, cut, rate * g / (h + 1), rate * (gs - g) / (hs - h + 1))
    return {n: t for n, (_, t) in best.items()}


def labelled_urls(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """URLs whose last number is a labelled document; y = 1 for good quality that is not toxic."""
    number = F.try_to_number(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*[^?#]*?/([0-9]{1,15})(?:\.[a-z]+|/)?(?:[?#].*)?$", 1), F.lit("999999999999999"))
    known = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int").alias("y"))
    return pages.select(F.col(url).alias("url"), number.cast("long").alias("_id")).filter("_id is not null").join(known, "_id").select("url", "y")


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str]] = RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """The table with host, path, rule, score (probability of allow) and verdict."""
    new = {"host", "path", "rule", "score", "verdict"}
    kept = [c for c in pages.columns if c not in new]
    row = features(pages.select(F.struct(*kept).alias("row"), F.col(url).alias("_url")), "_url")
    scored = model.binned(row).withColumn("score", 1 / (1 + F.exp(-model.score())))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("row.*", "host", "path", rule.alias("rule"), F.round("score", 6).alias("score"),
                         F.coalesce(verdict, F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"))


def run(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """Train on the labelled URLs of ``pages`` and judge all of them."""
    scratch = Scratch(pages.sparkSession, "urls")
    model = train(scratch, features(labelled_urls(pages, labels, url), "url"))
    return judge(pages, model, rules, url)
