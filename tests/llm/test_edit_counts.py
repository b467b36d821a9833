import random

from tests.llm.helpers import docs, with_clashes
from tessera.llm import edit_counts as ec
from tessera.llm import pretokens

PIECES = ["'", "ll", "'s", " ", "  ", "\n", "don't", "<EMAIL>", "", "é", "123", "!!", "x" * 300 + " ", "word " * 200, "<|endoftext|>", "੦", "\U00010940"]


def counted(codec, text):
    return len(codec.library.encode(text, add_special_tokens=False).ids)


def test_counts_equal_a_full_recount_after_any_edits():
    codec, rng = pretokens.Codec(pretokens.vocabulary()), random.Random(1)
    texts = ["", "a", "  ", "'l l", "x  'll", "it's  we'll\n\n  go 12 34", "word " * 3000, "é" * 500 + " a" * 500, "a <|endoftext|> b", "\U00010940 x"]
    for text in texts * 12:
        edits = []
        for _ in range(rng.randint(1, 4)):
            start = rng.randint(0, len(text))
            edits.append((start, min(len(text), start + rng.choice([0, 0, 1, 2, 5, 200])), rng.choice(PIECES)))
        tree = ec.grow(codec, text)
        assert tree.tokens == counted(codec, text)
        after, tree, again = ec.apply_edits(codec, text, tree, edits)
        assert tree.tokens == counted(codec, after)
        assert tree.levels[-1][0, 0] == len(after)
        assert (tree.levels[0].sum(0) == tree.levels[-1][0]).all()


def test_a_small_edit_of_a_long_text_encodes_little_again():
    codec = pretokens.Codec(pretokens.vocabulary())
    text = "some words here " * 20_000
    _, _, again = ec.apply_edits(codec, text, ec.grow(codec, text), [(160_000, 160_004, "other")])
    assert 0 < again < 2_000


def test_tables_nulls_overlaps_and_clashing_columns(spark):
    texts = ["mail me: a.b@example.com now", None, "", "call 0123 456 789", "plain"]
    grown = ec.trees(spark, with_clashes(docs(spark, texts)))
    codec = pretokens.codec(pretokens.vocabulary())
    rows = {r["doc_id"]: r for r in ec.recount(spark, grown, ec.masking_edits).collect()}
    assert rows[0]["text"] == "mail me: <EMAIL> now" and rows[0]["n_edits"] == 1
    assert rows[3]["text"] == "call <NUMBER>"
    assert all(r["n_after"] == counted(codec, r["text"]) for r in rows.values())
    assert rows[1]["n_before"] == rows[2]["n_after"] == 0
    edits = spark.createDataFrame([(0, 0, 4, "post"), (0, 2, 6, "overlaps"), (0, 900, 901, "outside"), (4, 5, 5, None), (None, 0, 1, "x"), (3, 0, 4, "ring")], "doc_id long, start long, end long, replacement string")
    rows = {r["doc_id"]: r for r in ec.recount(spark, grown, edits).collect()}
    assert rows[0]["text"].startswith("post me") and rows[0]["n_edits"] == 1
    assert rows[3]["text"].startswith("ring") and rows[4]["text"] == "plain"
    assert ec.recount(spark, ec.trees(spark, docs(spark, [])), edits).count() == 0


def test_dense_edits_encode_no_text_twice():
    codec = pretokens.Codec(pretokens.vocabulary())
    text = "some words here, and others there " * 7_000
    edits = [(i, i + 3, "xyz!") for i in range(0, len(text) - 40, 31)]
    after, tree, again = ec.apply_edits(codec, text, ec.grow(codec, text), edits)
    assert tree.tokens == counted(codec, after) and again <= 1.02 * len(after)


def test_special_tokens_and_unsettled_characters_stay_local():
    codec = pretokens.Codec(pretokens.vocabulary())
    special = next(iter(codec.specials))
    for rare in (special, "\U00010940"):
        text = "some words here " * 3_000 + rare + " more of them" * 3_000
        tree = ec.grow(codec, text)
        assert len(tree.leaves) > 50 and tree.tokens == counted(codec, text)
        after, tree, again = ec.apply_edits(codec, text, tree, [(20, 24, "other")])
        assert tree.tokens == counted(codec, after) and again < 3_000
    parts = special[:5], special[5:]
    text = "a b " * 400 + parts[0] + "x" + parts[1] + "   " + special + " c d" * 400
    at = text.index("x")
    for edits in ([(at, at + 1, "")], [(text.index(special), text.index(special) + 3, "")], [(at, at + 1, ""), (text.index(special), text.index(special) + len(special), " ")]):
        after, tree, _ = ec.apply_edits(codec, text, ec.grow(codec, text), edits)
        assert tree.tokens == counted(codec, after), edits


def test_null_ids_repeated_rows_and_many_edits_at_one_place(spark):
    from pyspark.sql import functions as F

    table = docs(spark, ["one two three", "one two three", "four five"]).withColumn("doc_id", F.when(F.col("doc_id") < 2, F.lit(7)))
    grown = ec.trees(spark, table)
    edits = spark.createDataFrame([(7, 3, 3, f" {i:03d}") for i in range(200)] + [(7, 0, 3, "six"), (None, 0, 1, "x"), (7, 1 << 40, 1 << 40, "far")], "doc_id long, start long, end long, replacement string")
    rows = ec.recount(spark, grown, edits).collect()
    assert sorted(r["text"] for r in rows) == ["four five", "six 000 two three", "six 000 two three"]
    assert [r["n_edits"] for r in rows if r["doc_id"] == 7] == [2, 2]


def test_a_random_batch_on_the_drivers_documents():
    import duckdb

    codec, rng = pretokens.Codec(pretokens.vocabulary()), random.Random(3)
    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall():
        text = text or ""
        edits = [(s, min(len(text), s + rng.choice([0, 1, 9])), rng.choice(PIECES)) for s in (rng.randint(0, len(text)) for _ in range(rng.choice([1, 5, 80])))]
        after, tree, again = ec.apply_edits(codec, text, ec.grow(codec, text), edits)
        assert tree.tokens == counted(codec, after) and again <= len(after)
