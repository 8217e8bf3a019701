"""URL filter: listed rules first, then gradient-boosted trees on lexical features.

Rules name a host and the start of a path; a rule fits its host and every subdomain, and the longest rule that fits
decides.  URLs without a rule are judged by trees that were fitted to labelled URLs: lengths, depth, digit ratio, entropy,
parameter counts and the share of bad URLs per host suffix (smoothed towards the overall share).

The trees are fitted on at most ``fit_rows`` distinct labelled URLs (a bounded sample by hash, as fitting passes over the
rows many times), each weighing as much as it has labelled rows; the counts per suffix and the overall share are those of all
labelled rows, and every URL is scored.  With labels of fewer than two classes, in the table or in the sample, the verdict
follows the overall share: ``block`` where it reaches ``block_at``, ``allow`` otherwise and without labels.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule fits it and it is scored like any
other; equal URLs get equal verdicts; an empty table gives an empty result; input columns named as an output column are
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, let, small_join, stage

#: Bound on the labelled rows that the trees are fitted on.
FIT_ROWS = 20_000
FOLDS = 5

NUMBERS = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels",
           "query_length", "host_digit_ratio", "host_entropy", "suffix_bad", "suffix_seen"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """``example.com/en/`` is host ``example.com`` and path ``/en/``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, "(?s)^[^/?#]*", 0)), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls without one."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.text) if name is None else name.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, verdict)


def suffix(host: Column) -> Column:
    """The last three labels of a host."""
    return F.substring_index(host, ".", -3)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a text, 0 for an empty one."""
    ordered = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    zero = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0.0).alias("t"))

    def close(a: Column) -> Column:
        n = a["n"].cast("double")
        return a["t"] + F.when(n > 0, n * F.log2(n)).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["n"] + 1).otherwise(1).alias("n"),
                        F.when(same, a["t"]).otherwise(close(a)).alias("t"))

    size = F.char_length(text).cast("double")
    return F.when(size > 0, F.log2(size) - F.aggregate(ordered, zero, step, close) / size).otherwise(0.0)


def _ratio(text: Column, chars: str) -> Column:
    rest = F.char_length(F.regexp_replace(text, chars, ""))
    size = F.char_length(text)
    return F.when(size > 0, (size - rest) / size).otherwise(0.0)


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the lexical numbers as ``_pw_*`` and the suffix."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    made = {
        "url_length": F.char_length(url), "host_length": F.char_length(host), "path_length": F.char_length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")), "digit_ratio": _ratio(url, "[0-9]+"), "entropy": entropy(url),
        "parameters": F.size(F.filter(F.split(query, "[&;]"), lambda p: p != "")), "hyphens": F.char_length(host) - F.char_length(F.replace(host, F.lit("-"), F.lit(""))),
        "labels": F.size(F.split(host, "\\.")), "query_length": F.char_length(query),
        "host_digit_ratio": _ratio(host, "[0-9]+"), "host_entropy": entropy(host)}
    return urls.withColumns({f"_pw_{k}": v.cast("double") for k, v in made.items()} | {"_pw_suffix": suffix(host)})


@dataclass(frozen=True)
class Model:
    trees: GBTClassificationModel | None
    suffixes: DataFrame
    share: float


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, trees: int = 12, depth: int = 3, seed: int = 5) -> Model:
    """Fit to ``labelled`` (url, bad: 0 or 1; other rows are left out)."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select("url", F.col("bad").cast("double").alias("_pw_bad")).filter("_pw_bad IN (0.0, 1.0)")
    # all labelled rows are counted by suffix and fold; only the trees are fitted on a sample
    fold = F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(FOLDS)).alias("_pw_fold")
    folds = stage(rows.groupBy(suffix(host).alias("_pw_suffix"), fold).agg(F.count("*").cast("double").alias("_pw_fold_n"), F.sum("_pw_bad").alias("_pw_fold_b")))
    suffixes = stage(folds.groupBy("_pw_suffix").agg(F.sum("_pw_fold_n").alias("_pw_n"), F.sum("_pw_fold_b").alias("_pw_b")))
    n, bad = suffixes.agg(F.coalesce(F.sum("_pw_n"), F.lit(0.0)), F.coalesce(F.sum("_pw_b"), F.lit(0.0))).first()
    share = bad / n if n else 0.0
    if bad in (0, n):
        return Model(None, suffixes, share)
    rows = rows.groupBy("url", "_pw_bad").agg(F.count("*").cast("double").alias("_pw_weight"))
    if n > fit_rows:
        rows = stage(rows)
        n = rows.count()
    if n > fit_rows:  # a share by hash first, so that no task has to find the smallest hashes among all rows
        rows = rows.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < math.ceil(1_500_000 * fit_rows / n))
        rows = rows.orderBy(F.pmod(F.xxhash64("url"), F.lit(1_000_000)), "url", "_pw_bad").limit(fit_rows)
    made = stage(features(rows.withColumns({"host": host, "path": path})).withColumn("_pw_fold", fold))
    if made.select("_pw_bad").distinct().count() < 2:
        return Model(None, suffixes, share)
    # a row sees its suffix's labels from the other folds only, else the trees would read the label from them
    own = small_join(small_join(made, suffixes, ["_pw_suffix"]), folds, ["_pw_suffix", "_pw_fold"])
    own = own.withColumns({"_pw_n": F.col("_pw_n") - F.col("_pw_fold_n"), "_pw_b": F.col("_pw_b") - F.col("_pw_fold_b")})
    vectors = _vectors(own, share).select("_pw_x", "_pw_bad", "_pw_weight").coalesce(1)
    steps = GBTClassifier(featuresCol="_pw_x", labelCol="_pw_bad", weightCol="_pw_weight", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3,
                          minInstancesPerNode=20, seed=seed, cacheNodeIds=False, checkpointInterval=-1)
    return Model(steps.fit(vectors), suffixes, share)


def _vectors(rows: DataFrame, share: float, smooth: float = 20.0) -> DataFrame:
    n, b = F.coalesce(F.col("_pw_n"), F.lit(0.0)), F.coalesce(F.col("_pw_b"), F.lit(0.0))
    rows = rows.withColumns({"_pw_suffix_bad": (b + smooth * share) / (n + smooth), "_pw_suffix_seen": F.log1p(n)})
    return VectorAssembler(inputCols=[f"_pw_{c}" for c in NUMBERS], outputCol="_pw_x").transform(rows)


def judge(urls: DataFrame, rules: list[Rule], model: Model, block_at: float = 0.5) -> DataFrame:
    """``urls`` with host, path, rule, verdict and ``bad_probability`` (of the trees, for every URL)."""
    host, path = host_and_path(F.col("url"))
    out = features(urls.drop("host", "path", "rule", "verdict", "bad_probability").withColumns({"host": host, "path": path}))
    kept = [c for c in out.columns if not c.startswith("_pw_")]
    out = small_join(out, model.suffixes, ["_pw_suffix"], "left")
    if model.trees is None:
        out = out.withColumn("bad_probability", F.lit(float(model.share)))
        by_trees = F.lit("block" if model.share >= block_at else "allow")
    else:
        scored = model.trees.setFeaturesCol("_pw_x").setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_pw_p").transform(_vectors(out, model.share))
        out = scored.withColumn("bad_probability", vector_to_array("_pw_p")[1])
        by_trees = F.when(F.col("bad_probability") >= block_at, "block").otherwise("allow")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_trees)}).select(*kept, "rule", "verdict", "bad_probability")
