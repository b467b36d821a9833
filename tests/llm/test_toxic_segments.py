import random

from tests.llm.helpers import docs, prose, with_clashes
from tessera.llm import toxic_segments as ts


def segments_by_definition(x):
    """All maximal scoring segments: recursively, the best one, then those of what is left and right of it."""
    if not x:
        return []
    best = max(((sum(x[i:j]), -(j - i), -i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)))
    if best[0] <= 0:
        return []
    i, j = -best[2], best[3]
    right = [(a + j, b + j, s) for a, b, s in segments_by_definition(x[j:])]
    return [*segments_by_definition(x[:i]), (i, j - 1, best[0]), *right]


def test_scan_finds_all_maximal_segments():
    rng = random.Random(8)
    for _ in range(300):
        x = [rng.choice([-1.0, -1.0, rng.uniform(-3, 4)]) for _ in range(rng.randint(1, 14))]
        hot = [(i, s) for i, s in enumerate(x) if s != -1.0]
        got = [(a, b, round(s, 9)) for a, b, s in ts.maximal_segments(hot, 1.0)]
        assert got == [(a, b, round(s, 9)) for a, b, s in segments_by_definition(x)]


def test_held_out_documents_are_told_apart(spark):
    rng = random.Random(9)
    bad = ["vilest", "fouler", "rotten", "wretch"]
    texts = []
    for i in range(900):
        words = prose(rng, 80).split()
        if i % 6 == 0:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
    table = with_clashes(docs(spark, [*texts, None, ""]))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(900)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = ts.fit(spark, table, labels)
    rows = {r["doc_id"]: r["_score"] for r in ts.with_scores(table, model).collect()}
    held = [i for i in range(900) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert all((rows[i] >= 0.7) == (i % 6 == 0) for i in held)
    assert 0 <= rows[900] == rows[901] < 0.3
    found = ts.passages(table, model).where("doc_id = 0").collect()
    assert found and any(w in " ".join(r["passage"] for r in found) for w in bad)
    assert ts.with_scores(table.limit(0), model).count() == 0
    plain = ts.fit(spark, table, labels.where("toxic = 0"))
    assert all(r["_score"] < 0.7 for r in ts.with_scores(table, plain).collect())
    assert ts.with_scores(table, ts.fit(spark, table, labels.limit(0))).count() == 902


def test_scan_agrees_with_the_definition_on_longer_sequences():
    rng = random.Random(18)
    for _ in range(20):
        x = [rng.choice([-1.0, rng.uniform(-3, 2), rng.uniform(-1, 4)]) for _ in range(90)]
        hot = [(i, s) for i, s in enumerate(x) if s != -1.0]
        assert [(a, b, round(s, 9)) for a, b, s in ts.maximal_segments(hot, 1.0)] == [(a, b, round(s, 9)) for a, b, s in segments_by_definition(x)]


def test_scan_is_linear():
    import time

    took = []
    for n in (100_000, 400_000):
        # falling sums with isolated positives: each starts below all before it; and rising ones that merge at the end
        hot = [(3 * i, 1.0) for i in range(n)] + [(3 * n, 10.0 * n)]
        began = time.perf_counter()
        assert len(ts.maximal_segments(hot, 1.0)) >= 1
        rising = [(2 * i, 1.5) for i in range(n)]
        assert ts.maximal_segments(rising, 1.0) == [(0, 2 * n - 2, 1.5 * n - (n - 1))]
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def test_long_texts_null_ids_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(19)
    clean = [prose(rng, 60) for _ in range(300)]
    toxic = [t + " vilest rotten fouler" * 3 for t in clean[:100]]
    table = docs(spark, clean + toxic)
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = ts.fit(spark, table, labels)
    long_clean, long_toxic = " ".join(clean * 20), " ".join(clean * 20) + " vilest rotten fouler" * 60
    extra = docs(spark, [long_clean, long_toxic, long_toxic, toxic[0]], first=1000).withColumn("doc_id", F.when(F.col("doc_id") < 1003, F.col("doc_id")))
    rows = [r["_score"] for r in ts.with_scores(extra, model).collect()]
    assert rows[0] < 0.7 <= min(rows[1:]) and rows[1] == rows[2]


def test_held_out_documents_of_the_driver(spark):
    """Held-out accuracy on the driver's tables. Junk texts that are labelled toxic without a toxic passage can't be found."""
    from tessera.llm import common

    where = "/root/testdata/sf0.1"
    labels = common.table(spark, where, "labels").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    rows = ts.op5_toxicity(spark, where).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    assert len(toxic) > 100 and sum(toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.005 * len(rows)
