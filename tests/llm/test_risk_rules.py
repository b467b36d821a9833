import math
import random
from collections import Counter

from tests.llm.helpers import WORDS, docs, prose, with_clashes
from tessera.llm import risk_rules as rr


def brute(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_counts_match_the_definition():
    rng = random.Random(6)
    texts = ["", " \n\t", "a", "a b", "a a a a", "x y z x y z x y z", "l1\nl2\nl1\n\n \nl1", "é#\x1c*\xa0b", prose(rng, 300, 5), "a\x0bb\x0cc\rd"]
    for t in texts:
        assert rr.measure(t)[:5] == brute(t), t


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.1), (10, 3, 0.2), (500, 2, 0.01), (5, 5, 0.3)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(rr.binomial_tail(k, n, p) - want) < 1e-12


def test_certification_stops_at_the_first_failure():
    assert rr.certified([0, 1, 90, 90], 2000, 0.01, 0.001) == 2
    assert rr.certified([0, 90, 0], 2000, 0.01, 0.001) == 1
    assert rr.certified([0], 50, 0.01, 0.001) == 0 and rr.certified([0], 0, 0.01, 0.001) == 0


def test_tail_of_many_documents_is_quick_and_agrees_from_both_sides():
    import time

    began = time.perf_counter()
    assert rr.binomial_tail(1_999_000, 100_000_000, 0.02) < 0.5 < rr.binomial_tail(2_001_000, 100_000_000, 0.02)
    assert time.perf_counter() - began < 2
    for n in (50, 200):
        for k in range(n):
            want = sum(math.comb(n, i) * 0.1**i * 0.9 ** (n - i) for i in range(k + 1))
            assert abs(rr.binomial_tail(k, n, 0.1) - want) < 1e-11


def test_rules_reject_junk_and_hold_the_risk(spark):
    rng = random.Random(7)
    good = [prose(rng, 60) for _ in range(1500)]
    bad = [" ".join(w + "%%%" for w in prose(rng, 60).split()) for _ in range(150)]
    table = docs(spark, good + bad + [None, "", "short"])
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(0, 1650)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in rr.quality(spark, with_clashes(table), labels).collect()}
    assert sum(not rows[i]["kept"] for i in range(1500)) <= 15
    assert sum(not rows[i]["kept"] for i in range(1500, 1650)) >= 140
    assert rows[1650]["base_failed"] and rows[1650]["n_words"] == 0 and not rows[1652]["kept"]
    none = rr.quality(spark, table, labels.limit(0))
    assert none.where("not base_failed and not kept").count() == 0
    assert rr.quality(spark, table.limit(0), labels).count() == 0


def languages(spark, many, each, junk_share=0.1):
    """Good texts, all different, and junk, in many languages."""
    from pyspark.sql import functions as F

    good = prose(random.Random(8), 60, 4000)
    junk = F.floor(F.col("id") / many) >= int(each * (1 - junk_share))
    plain = F.concat(F.lit(good + " w"), F.col("id").cast("string"))
    table = spark.range(many * each).select(F.col("id").alias("doc_id"), F.when(junk, F.regexp_replace(plain, "([a-z]) ", "$1%%% ")).otherwise(plain).alias("text"), F.concat(F.lit("l"), (F.col("id") % many).cast("string")).alias("lang"))
    return table, spark.range(many * each).select(F.col("id").alias("doc_id"), F.when(junk, 0).otherwise(1).alias("quality"))


def test_every_language_gets_its_rules(spark):
    table, labels = languages(spark, 40, 700)
    out = rr.quality(spark, table, labels).join(labels, "doc_id")
    assert out.where("quality = 0 and kept").count() == 0 and out.where("quality = 1 and not kept").count() == 0


def test_null_and_empty_language_are_apart(spark):
    from pyspark.sql import functions as F

    table, labels = languages(spark, 2, 900)
    null = table.withColumn("lang", F.when(F.col("lang") == "l0", F.lit("")))
    only_empty = labels.join(table.where("lang = 'l0'").select("doc_id"), "doc_id")
    out = rr.quality(spark, null, only_empty).join(labels, "doc_id")
    assert out.where("quality = 0 and lang = '' and kept").count() == 0
    assert out.where("quality = 0 and lang is null and not kept").count() == 0


def test_copies_are_no_further_trials(spark):
    from pyspark.sql import functions as F

    table, labels = languages(spark, 1, 60)  # too few different texts
    copies = table.join(spark.range(30).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("copy")).drop("copy")
    marked = labels.join(spark.range(30).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("copy")).drop("copy")
    assert rr.fit(rr.with_features(rr.measures(copies)), marked) == []


def test_the_union_of_rules_holds_the_risk(spark):
    """Six rules that each reject 1.2 % of the good documents, and different ones, are not all used."""
    rng = random.Random(5)
    from pyspark.sql import functions as F

    rows = []
    for i in range(6000):
        bad, k = i % 4 == 0, rng.randrange(500)
        ratios = {r: 0.0 for r in rr.GRID}
        for j, rule in enumerate(rr.GRID):
            if bad or 6 * j <= k < 6 * j + 6:
                ratios[rule] = 99.0
        rows.append((i, "en", f"{rng.getrandbits(128):032x}", False, *ratios.values()))
    features = spark.createDataFrame(rows, "doc_id long, lang string, digest string, base_failed boolean, " + ", ".join(f"{r} double" for r in rr.GRID))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, 0).otherwise(1).alias("quality"))
    (policy,) = rr.fit(features, labels)
    assert 1 <= len(policy.cutoffs) < 3
    out = rr.judge(features, [policy]).join(labels, "doc_id")
    assert out.where("quality = 1 and not kept").count() <= 0.02 * 4500
