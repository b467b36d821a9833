import random
from collections import Counter

from tests.llm.helpers import docs, prose, with_clashes
from tessera.llm import common
from tessera.llm import suffix_index as si


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = set()
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(bytes(b for i, b in enumerate(r) if i not in gone))
    return out


def corpus(rng):
    shared = [prose(rng, 60) for _ in range(3)]
    texts = [prose(rng, 80) for _ in range(12)]
    texts += [prose(rng, 20) + " " + rng.choice(shared) + " " + prose(rng, 20) for _ in range(14)]
    texts += [texts[0], texts[1][:300] + "X" + texts[1][300:], "ab" * 400, "é" * 150, "é" * 90 + shared[0], None, "", "short", "x" * 199, "x" * 200, "y" * 201, shared[1][5:210] + shared[1][:205]]
    return texts


def test_kept_bytes_match_brute_force(spark):
    texts = corpus(random.Random(16))
    got = {r["doc_id"]: r for r in si.deduplicated(spark, with_clashes(docs(spark, texts))).collect()}
    for i, want in enumerate(brute(texts, 200)):
        assert bytes(got[i]["kept"]) == want, i
        spans = [(s["start"], s["stop"]) for s in got[i]["removed"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert got[i]["n_bytes"] - sum(b - a for a, b in spans) == len(want)
    text = si.deduplicated(spark, docs(spark, texts), as_text=True).collect()
    assert all(isinstance(r["kept"], str) for r in text)


def test_long_keys_long_texts_and_any_batches_give_the_same(spark, monkeypatch):
    texts = corpus(random.Random(17))
    edge = prose(random.Random(27), 40)
    texts += [prose(random.Random(100 + i), 30) + edge + prose(random.Random(200 + i), 30) for i in range(25)]  # an anchor with many kinds
    monkeypatch.setattr(si, "PIECE", 300)
    common.prepare(spark)
    rows = docs(spark, texts).selectExpr("doc_id", "cast(0 as long) as th", "text", "1L as many")
    want = brute(texts, 200)
    for group, batches in ((1, 1), (3, 2)):
        spans = {r["doc_id"]: si.merged(r["spans"]) for r in si.repeated_spans(spark, rows, 200, group, batches).collect()}
        assert [si.cut((t or "").encode(), spans.get(i, [])) for i, t in enumerate(texts)] == want, (group, batches)


def test_equal_windows_by_definition():
    rng = random.Random(18)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 20))).encode() for _ in range(60)]
    seen = Counter(s[i : i + 8] for s in strings for i in range(len(s) - 7))
    for s, found in zip(strings, si.equal_windows(strings, 8)):
        assert found == {i for i in range(len(s) - 7) if seen[s[i : i + 8]] > 1}


def test_the_family_meets_later_batches_and_merges_geometrically(spark):
    rng = random.Random(28)
    shared, common_ = prose(rng, 60), prose(rng, 60)
    common.prepare(spark)
    family, met = si.Family(spark), []
    for k in range(5):
        texts = [prose(rng, 80), prose(rng, 30) + common_, (shared if k in (1, 4) else prose(rng, 60))]
        rows = docs(spark, texts, first=10 * k).selectExpr("doc_id", "cast(0 as long) as th", "text", "1L as many")
        met.append({r["doc_id"] for r in family.add(rows).select("doc_id").distinct().collect()})
    assert met[0] == set() and 1 in met[1] and 11 in met[1] and 12 not in met[1] and {12, 42, 1, 11, 41} <= met[4] and 0 not in met[4]
    assert [size for size, _ in family.levels] == [4, 1]
    family.drop()


def test_equal_rows_are_one_text_with_a_multiplicity(spark, monkeypatch):
    from pyspark.sql import functions as F

    text = prose(random.Random(29), 60)
    table = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    seen = []
    monkeypatch.setattr(si, "with_bytes", lambda rows, wanted, length, f=si.with_bytes: (seen.append(rows.count()), f(rows, wanted, length))[1])
    got = si.deduplicated(spark, table).collect()
    assert len(got) == 1000 and all(len(r["kept"]) == 0 for r in got) and seen == [1]


def test_repeated_ids_null_ids_and_empty_tables(spark):
    rng = random.Random(19)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (None, b, "en", "s", 1), (None, None, "en", "s", 1), (2, prose(rng, 60), "en", "s", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = si.deduplicated(spark, table).collect()
    assert len(got) == 6
    assert sorted(len(r["kept"]) for r in got)[:5] == [0] * 5
    assert si.deduplicated(spark, table.limit(0)).count() == 0
