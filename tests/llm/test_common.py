import os

from pyspark.sql import functions as F

from tessera.llm import common


def test_hash_sample_is_stable_and_of_the_size_asked_for(spark):
    rows = spark.range(20_000)
    few = {r["id"] for r in common.hash_sample(rows, 20_000, 2_000, "id").collect()}
    assert 1_700 < len(few) < 2_300
    assert few == {r["id"] for r in common.hash_sample(rows.repartition(7), 20_000, 2_000, "id").collect()}
    assert common.hash_sample(rows, 20_000, 20_000, "id").count() == 20_000


def test_written_tables_come_back_and_go(spark):
    back = common.written(spark, spark.range(10).withColumn("x", F.col("id") * 2), "test")
    assert back.agg(F.sum("x")).first()[0] == 90
    folder = back._tessera_path.removeprefix("file://")
    assert os.path.isdir(folder)
    common.drop_written(spark, back)
    assert not os.path.exists(folder)


def test_repeated_and_null_ids_are_seen(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert not common.repeated_ids(rows) and not common.repeated_ids(rows.limit(0))
    assert common.repeated_ids(rows.unionByName(spark.createDataFrame([(2, "c")], rows.schema)))
    assert common.repeated_ids(rows.unionByName(spark.createDataFrame([(None, "c")], rows.schema)))


def test_hold_out_buckets(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for r in rows.select("doc_id", common.crc_bucket(F.col("doc_id"), 7).alias("b")).collect():
        assert r["b"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 7
