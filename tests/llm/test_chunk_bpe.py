import hashlib
import random

from tests.llm.helpers import docs, prose, with_clashes
from tessera.llm import chunk_bpe, pretokens


def test_every_text_encodes_as_the_library_does_and_comes_back(spark):
    rng = random.Random(3)
    base = prose(rng, 4000)
    texts = [base, base, base[500:9000] + " 'll " + base, None, "", "a", " " * 3000, "'" * 999, "it's we'll " * 800, "<|endoftext|>" * 40, base[:3000] + "<|endoftext|>" + base[:3000], "é" * 4000, "\U00010940 " * 400, "日本語 " * 900, "x" * 70_000, "ab\n\n  cd\t" * 700]
    texts += [base[i * 17 :] for i in range(20)]
    table = with_clashes(docs(spark, texts))
    library = pretokens.Codec(pretokens.vocabulary()).library
    rows = {r["doc_id"]: r for r in chunk_bpe.decode(spark, chunk_bpe.encode(spark, table)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == want, i
        assert rows[i]["text"] == library.decode(want, skip_special_tokens=False) == (t or "")
    digests = {r["doc_id"]: r for r in chunk_bpe.digests(chunk_bpe.decode(spark, chunk_bpe.encode(spark, table))).collect()}
    assert digests[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, rows[0]["ids"])).encode()).hexdigest()
    assert digests[4]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chunk_bpe.encode(spark, table.limit(0)).count() == 0


def test_equal_passages_fall_into_equal_chunks():
    rng = random.Random(4)
    shared = prose(rng, 3000)
    a, b = (set(chunk_bpe.chunks(prose(rng, 500) + shared)) for _ in range(2))
    assert sum(len(c) for c in a & b) > 0.6 * len(shared)


def test_joins_agree_wherever_the_cuts_fall(monkeypatch):
    codec, rng = pretokens.Codec(pretokens.vocabulary()), random.Random(5)
    bits = ["'", "l", "ll", "re", " ", "  ", "\n", "a", "Z", "9", "!", "é", "…", "we", "'ve", "\U00010940"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        at = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(0, 6)))) if len(text) > 1 else []
        monkeypatch.setattr(chunk_bpe, "chunks", lambda t, at=at: [t[a:b] for a, b in zip([0, *at], [*at, len(t)])])
        assert list(chunk_bpe.encode_part(codec, text, chunk_bpe.Cache(), {})) == codec.library.encode(text, add_special_tokens=False).ids, (text, at)


def test_the_dictionary_is_full_however_alike_its_chunks_are(spark, monkeypatch):
    from pyspark.sql import functions as F

    worth = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("key"), F.lit(2000).cast("long").alias("size"), F.lit(2000).cast("long").alias("worth"))
    best = worth.limit(10).withColumns({"key": F.concat("key", F.lit(b"x")), "worth": F.lit(90_000).cast("long")})
    got = chunk_bpe.worth_most(worth.unionByName(best))
    assert got.where("worth = 90000").count() == 10
    assert 0.8 * chunk_bpe.DICTIONARY_BYTES < got.count() * 2000 < 1.1 * chunk_bpe.DICTIONARY_BYTES


def test_the_cache_keeps_what_was_used_last():
    codec = pretokens.Codec(pretokens.vocabulary())
    cache = chunk_bpe.Cache(2)
    for chunk in ("aa", "bb", "aa", "cc", "aa"):
        cache.of(codec, chunk)
    assert list(cache) == ["cc", "aa"] and (cache.hits, cache.misses) == (4, 6)


def test_null_ids_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    table = docs(spark, ["one two", "one two", "three"]).withColumn("doc_id", F.when(F.col("doc_id") == 2, F.lit(5)))
    rows = chunk_bpe.digests(chunk_bpe.decode(spark, chunk_bpe.encode(spark, table))).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == [("5", 1), ("None", 2), ("None", 2)]
