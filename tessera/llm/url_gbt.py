"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest.

Host and path are cut from the url by string functions. A rule ``host/path`` fits its host and all subdomains if the url's path starts with
the rule's; the longest rule wins. Urls that a rule judges are the labelled ones. The trees are fitted on a bounded sample of the distinct ones
among them, however often each occurs, on average ``SAMPLE`` of each verdict, chosen by the hash of the url, with these features: lengths, depth, digit and letter ratios, character
entropy, counts of parameters, hyphens, dots and labels, and the smoothed share of blocked urls among the sample's other urls with the same last
host label and with the same first path segment. A url of the sample gets the shares of the ``FOLDS`` - 1 folds that it isn't in, so that its own verdict
tells the trees nothing. All others are judged by the fitted trees, written out as one SQL expression; the shares are a table of at most one row a sampled url.

Nulls: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the trees. A null page id is kept. Repeated
rows are judged row by row, and urls of any length as a whole. Equal urls get equal verdicts. With labelled urls of one verdict only, that is the verdict of the rest; without any it
is allow. Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

SAMPLE, TREES, DEPTH, SEED = 10_000, 12, 4, 7
#: Urls that a leaf of a tree stands for at least.
LEAF_URLS = 5
#: Folds of the sample, and urls that the overall share counts for in a smoothed one.
FOLDS, SMOOTH = 5, 10.0
#: The rules of the query, with their verdicts.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
FEATURES = ("n_url", "n_host", "n_path", "depth", "digit_ratio", "host_digit_ratio", "letter_ratio", "entropy", "host_entropy", "n_params", "n_hyphens", "n_labels", "n_query", "has_fragment", "https", "suffix_share", "segment_share")


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host, path and rest (query and fragment)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    known = F.instr(url, "://") > 0
    part = lambda i: F.when(known, F.regexp_extract(url, PARTS, i)).otherwise(F.lit(""))
    return urls.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2), "rest": part(3)})


def rule_of(rules: dict[str, str]) -> Column:
    """The longest rule that fits host and path, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters of a-z, 0-9 and the rest as one, in bits."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    low, total, seen = F.lower(text), F.lit(0.0), F.lit(0)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        k = F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))
        total, seen = total - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0), seen + k
    other = F.length(low) - seen
    return total - F.when(other > 0, other / n * F.log2(other / n)).otherwise(0.0)


def count_of(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]", "")).cast("double")


def with_features(parts: DataFrame) -> DataFrame:
    url, host, path, rest = F.coalesce(F.col("url").cast("string"), F.lit("")), F.col("host"), F.col("path"), F.col("rest")
    size = lambda t: F.length(t).cast("double")
    ratio = lambda a, t: a / F.greatest(size(t), F.lit(1.0))
    params = F.when(rest.startswith("?"), 1 + count_of(rest, "&")).otherwise(0.0)
    return parts.withColumns(
        {
            "n_url": size(url), "n_host": size(host), "n_path": size(path), "depth": count_of(path, "/"),
            "digit_ratio": ratio(count_of(url, "0-9"), url), "host_digit_ratio": ratio(count_of(host, "0-9"), host), "letter_ratio": ratio(count_of(url, "A-Za-z"), url),
            "entropy": entropy(url), "host_entropy": entropy(host), "n_params": params, "n_hyphens": count_of(host, "-"),
            "n_labels": count_of(host, "."), "n_query": size(rest), "has_fragment": F.contains(rest, F.lit("#")).cast("double"), "https": url.startswith("https").cast("double"),
            "suffix": F.substring_index(host, ".", -1), "segment": F.regexp_extract(path, "^/([^/]*)", 1),
        }
    )


def tree_sql(debug: str) -> list[str]:
    """The nested SQL expressions of a fitted ensemble, from its printed form."""
    trees: list[list[str]] = []
    for line in debug.splitlines():
        if re.match(r"\s+Tree \d+", line):
            trees.append([])
        elif trees and line.strip():
            trees[-1].append(line.strip())

    def build(lines: list[str]) -> str:
        line = lines.pop(0)
        if m := re.match(r"Predict: (\S+)", line):
            return f"CAST({m[1]} AS DOUBLE)"
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = build(lines)
        lines.pop(0)  # the matching Else
        return f"CASE WHEN {FEATURES[int(m[1])]} <= CAST({m[2]} AS DOUBLE) THEN {left} ELSE {build(lines)} END"

    return [build(t) for t in trees]


class UrlModel:
    """A fitted model: blocked urls (b) of all (n) by suffix and by segment, and one SQL expression that is positive for block."""

    def __init__(self, margin: str, counts: dict[str, DataFrame], share: float):
        self.margin, self.counts, self.share = margin, counts, share

    def with_shares(self, features: DataFrame) -> DataFrame:
        out = features
        for name in ("suffix", "segment"):
            share = F.lit(self.share)
            if name in self.counts:
                own = self.counts[name].groupBy(F.col(name).alias("_key")).agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"))
                out = out.join(F.broadcast(own), F.col(name) == F.col("_key"), "left")  # at most a row for each url of the sample
                share = _smooth(F.coalesce("_b", F.lit(0.0)), F.coalesce("_n", F.lit(0)), self.share)
            out = out.withColumn(f"{name}_share", share).drop("_key", "_n", "_b")
        return out

    def with_other_shares(self, sample: DataFrame) -> DataFrame:
        """For the sample itself: the shares without the url's own fold."""
        out = sample
        for name in ("suffix", "segment"):
            by = self.counts[name]
            whole = by.groupBy(F.col(name).alias("_key")).agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"))
            own = by.select(F.col(name).alias("_key"), F.col("fold").alias("_fold"), F.col("n").alias("_n0"), F.col("b").alias("_b0"))
            others = whole.join(own, "_key").select("_key", "_fold", (F.col("_n") - F.col("_n0")).alias("_n"), (F.col("_b") - F.col("_b0")).alias("_b"))
            out = out.join(others, (F.col(name) == F.col("_key")) & (F.col("fold") == F.col("_fold"))).withColumn(f"{name}_share", _smooth(F.col("_b"), F.col("_n"), self.share)).drop("_key", "_fold", "_n", "_b")
        return out

    def verdict(self) -> Column:
        return F.when(F.expr(self.margin) > 0, F.lit("block")).otherwise(F.lit("allow"))


def _smooth(b: Column, n: Column, share: float) -> Column:
    return (b + SMOOTH * share) / (n + SMOOTH)


def chosen(labelled: DataFrame) -> DataFrame:
    """The training sample: distinct labelled urls, on average at most SAMPLE of each label."""
    distinct = common.cut_lineage(labelled.sparkSession, labelled.select("url", "host", "path", "rest", "label").dropDuplicates(["url"]))
    many = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    few = [common.hash_sample(distinct.where(F.col("label") == y), many.get(y, 0), SAMPLE, "url") for y in (0.0, 1.0)]
    return few[0].unionByName(few[1])


def learner() -> GBTClassifier:
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF_URLS, seed=SEED, stepSize=0.3)


def training(spark: SparkSession, labelled: DataFrame) -> tuple[UrlModel, DataFrame | None]:
    """The model without its trees, and the rows (features, label) to fit them on; None if there is nothing to learn."""
    rows = common.cut_lineage(spark, with_features(chosen(labelled)).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))))
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("b")).first()
    n, blocked = total["n"], total["b"] or 0.0
    if blocked == 0 or blocked == n:
        return UrlModel("1" if n and blocked == n else "-1", {}, 0.0), None
    counts = {c: common.cut_lineage(spark, rows.groupBy(c, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("b"))) for c in ("suffix", "segment")}
    model = UrlModel("0", counts, blocked / n)
    # one sorted partition of a bounded sample: the fit doesn't depend on how rows are dealt out
    return model, VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(model.with_other_shares(rows)).select("features", "label", "url").coalesce(1).sortWithinPartitions("url")


def fit(spark: SparkSession, labelled: DataFrame) -> UrlModel:
    """Fits on rows (url, host, path, rest, label), label 1.0 for block; a bounded sample of the distinct urls is used."""
    model, data = training(spark, labelled)
    if data is not None:
        fitted = learner().fit(data)
        model.margin = " + ".join(f"({w} * ({t}))" for w, t in zip(fitted.treeWeights, tree_sql(fitted.toDebugString)))
    return model


def judged(spark: SparkSession, urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """All columns of ``urls``, with host, path, rule and verdict."""
    spare = [c for c in urls.columns if c in {"host", "path", "rest", "rule", "verdict", "label", "suffix", "segment", *FEATURES}]
    parts = with_parts(urls.drop(*spare)).withColumn("rule", rule_of(rules))
    verdicts = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])[F.col("rule")]
    labelled = parts.where(F.col("rule").isNotNull()).withColumn("label", (verdicts == "block").cast("double"))
    model = fit(spark, labelled)
    return model.with_shares(with_features(parts)).withColumn("verdict", F.coalesce(verdicts, model.verdict())).drop("rest", "suffix", "segment", *FEATURES)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark, common.table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select(F.col("page_id").cast("long"), "host", "path", "rule", "verdict")
