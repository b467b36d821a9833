import random

import corpus_pipeline as cp
from tests.llm.helpers import docs, prose, with_clashes
from tests.llm.test_suffix_index import brute


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    rng = random.Random(20)
    bad = "vilest fouler rotten wretch vilest fouler"
    clean = [prose(rng, 90) for _ in range(120)]
    toxic = [prose(rng, 40) + " " + bad + " " + prose(rng, 40) for _ in range(60)]
    shared = prose(rng, 60)
    item = prose(rng, 25)
    texts = clean + toxic + [clean[3], clean[4], prose(rng, 50) + shared, prose(rng, 50) + shared, prose(rng, 60) + " " + item + " " + prose(rng, 60), None, "é" * 120]
    table = with_clashes(docs(spark, texts))
    d = str(tmp_path)
    table.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 120)) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, d)
        assert out.dtypes == table.dtypes, name
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert not set(range(120, 180)) & set(kept["toxicity"]) and len(kept["toxicity"]) == 127
    assert set(kept["toxicity"]) - set(kept["simhash_near_dedup"]) == {180, 181}
    before = kept["simhash_near_dedup"]
    want = dict(zip(before, brute(list(before.values()), 200)))
    assert {i: (t or "").encode() for i, t in kept["suffix_array_dedup"].items()} == {i: w.decode("utf-8", "ignore").encode() for i, w in want.items()}
    assert set(kept["suffix_array_dedup"]) - set(kept["decontamination"]) == {184}
    rows = cp.run(spark, d).collect()
    assert {r["doc_id"] for r in rows} == set(kept["decontamination"])


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    table = docs(spark, ["a b c d e", "a b c d e", "other words in here"])
    out = cp.near_duplicates(spark, table.unionByName(table), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2]


def test_near_duplicates_with_edits_go(spark):
    rng = random.Random(21)
    clean = [prose(rng, 200) for _ in range(30)]
    copies = []
    for t in clean:
        words = t.split()
        for i in (20, 90, 160):  # 15 of 196 shingles change: similarity 0.858
            words[i] = "edited"
        copies.append(" ".join(words))
    halves = [" ".join(t.split()[:100]) + " " + prose(rng, 100) for t in clean]
    out = cp.near_duplicates(spark, docs(spark, clean + copies + halves), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(30), *range(60, 90)]
