"""Invariants and golden cases of the samplers."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking, samplers, stats


def indices(spark, n):
    return spark.range(n).withColumnRenamed("id", "index")


def order(df):
    return [r["index"] for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("n,block", [(10, 3), (2, 3), (12, 4), (0, 3), (1, 1)])
def test_weak_shuffle_permutes_whole_blocks(spark, n, block):
    got = order(samplers.weak_shuffle(indices(spark, n), block))
    assert sorted(got) == list(range(n))
    full = n - n % block
    assert got[full:] == list(range(full, n))
    for i in range(0, full, block):
        assert got[i : i + block] == list(range(got[i], got[i] + block)) and got[i] % block == 0


def test_epochs_differ_seeds_repeat_and_partitions_do_not_matter(spark):
    a = order(samplers.weak_shuffle(indices(spark, 200), 4))
    assert a == order(samplers.weak_shuffle(indices(spark, 200).repartition(7), 4))
    assert a != order(samplers.weak_shuffle(indices(spark, 200), 4, epoch=1))


def batch(spark, values, b=0):
    return spark.createDataFrame([(b, p, v) for p, v in enumerate(values)], "batch_id long, pos long, index long")


def ranks(df):
    out = {}
    for r in df.orderBy("batch_id", "rank", "slot").collect():
        out.setdefault(r["rank"], []).append(r["index"])
    return out


def test_rank_slices(spark):
    five = batch(spark, [10, 11, 12, 13, 14])
    assert ranks(samplers.rank_slices(five, 2)) == {0: [10, 11, 12], 1: [13, 14, 10]}
    assert ranks(samplers.rank_slices(five, 2, drop_last=True)) == {0: [10, 11], 1: [12, 13]}
    assert ranks(samplers.rank_slices(batch(spark, [7]), 3)) == {0: [7], 1: [7], 2: [7]}
    assert ranks(samplers.rank_slices(batch(spark, [7]), 3, drop_last=True)) == {}
    with pytest.raises(ValueError):
        samplers.rank_slices(five, 0)


def labelled(spark):
    return spark.createDataFrame([(i, i % 3 // 2) for i in range(90)], "id long, label long")


def test_weighted_draws_are_balanced(spark):
    got = samplers.weighted_with_replacement(labelled(spark), "id", "label").groupBy("label").count().collect()
    assert sum(r["count"] for r in got) == 90 and all(25 <= r["count"] <= 65 for r in got)
    once = samplers.weighted_without_replacement(labelled(spark), "id", "label")
    assert sorted(r["id"] for r in once.collect()) == list(range(90))


def test_one_time_batches_take_every_row_once(spark):
    rows = samplers.one_time_batches(labelled(spark), "id", "label", 32).orderBy("pos").collect()
    assert sorted(r["id"] for r in rows) == list(range(90))
    assert [r["label"] for r in rows] == [0] * 60 + [1] * 30
    assert [r["batch_id"] for r in rows] == [i // 32 for i in range(90)]
    ordered = samplers.one_time_batches(labelled(spark), "id", "label", 32, seed=None).where("label = 1").orderBy("pos").collect()
    assert [r["id"] for r in ordered] == list(range(2, 90, 3))


def test_ranks_from_a_range_shuffle_equal_those_of_a_window(spark, monkeypatch):
    rows = spark.createDataFrame([(i, (i * 37) % 101, None if i % 10 == 0 else i % 2) for i in range(300)], "id long, v long, k long").repartition(5)
    by_window = [{tuple(r) for r in f(rows).collect()} for f in (lambda d: ranking.global_rank(d, ["v", "id"]), lambda d: ranking.rank_within(d, ["k"], ["v", "id"]))]
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 0)
    by_range = [{tuple(r) for r in f(rows).collect()} for f in (lambda d: ranking.global_rank(d, ["v", "id"]), lambda d: ranking.rank_within(d, ["k"], ["v", "id"]))]
    assert by_window == by_range


def test_class_weights_by_value(spark):
    rows = spark.createDataFrame([(5,), (5,), (9,)], "label long")
    assert sorted(r["weight"] for r in stats.class_weights(rows, "label").collect()) == [0.5, 0.5, 1.0]


def test_collation_keeps_the_order(spark):
    rows = samplers.one_time_batches(labelled(spark), "id", "label", 40)
    got = samplers.collated(rows, ["id", "label"]).orderBy("batch_id").collect()
    assert [i for r in got for i in r["id"]] == [r["id"] for r in rows.orderBy("pos").collect()]
    assert [len(r["label"]) for r in got] == [40, 40, 10]


def test_uniform_numbers_lie_inside(spark):
    row = spark.range(5000).select(samplers.uniform(1, "id").alias("u")).agg(F.min("u").alias("a"), F.max("u").alias("b"), F.avg("u").alias("m")).first()
    assert 0 < row["a"] and row["b"] < 1 and abs(row["m"] - 0.5) < 0.02
