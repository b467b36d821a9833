import random
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose, with_clashes
from tessera.llm import template_leaks as tl

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and Alice waits 3 hours before the next train follows on the same track towards the far coast."),
    (2, "The quick heron stood in the shallow water near the old mill and watched small fish go by until dusk."),
    (3, "Six words are enough to match"),
    (4, "too short here"),
    (None, "An item without an id that nobody should ever be matched with at all here."),
]


def test_leaks_with_other_slots_and_without(spark):
    rng = random.Random(10)
    items = spark.createDataFrame([*ITEMS, (9, ITEMS[1][1])], "item_id long, text string")
    texts = [
        prose(rng, 50) + ". " + ITEMS[0][1] + " " + prose(rng, 50),
        "Intro. " + ITEMS[0][1].replace("60", "85").replace("Boston", "Denver").replace("Alice", "Robert").replace(" 3 ", " 7 "),
        ITEMS[1][1].upper() + " " + prose(rng, 30),
        "well, " + ITEMS[2][1].lower() + ", so",
        "too short here",
        prose(rng, 400),
        None,
        "",
        " ".join(ITEMS[1][1].split()[:9]),
    ]
    table = docs(spark, texts)
    got = {r["doc_id"]: r for r in tl.leaking_documents(spark, with_clashes(table.unionByName(table.where("doc_id = 0"))), items).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert got[0]["item_id"] == got[1]["item_id"] == 1 and got[2]["item_id"] == 2 and got[3]["item_id"] == 3 and got[4]["item_id"] == 4
    assert got[0]["coverage"] == 1.0 > got[1]["coverage"]
    assert tl.leaking_documents(spark, table.limit(0), items).count() == 0
    assert tl.leaking_documents(spark, table, items.limit(0)).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "the box holds 5 red balls and 5 blue balls and 5 green balls and also 5 white balls in all of it"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    swapped = item.replace("5", "8")
    mixed = "the box holds 1 red balls and 2 blue balls and 3 green balls and also 4 white balls in all of it"
    got = [r["doc_id"] for r in tl.leaking_documents(spark, docs(spark, [item, swapped, mixed]), items).collect()]
    assert sorted(got) == [0, 1]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(11)
    items = spark.createDataFrame([(i, prose(rng, 20)) for i in range(5)], "item_id long, text string")
    table = docs(spark, [prose(rng, 30) + " " + r["text"] for r in items.collect()] + [prose(rng, 60)])
    want = sorted(map(tuple, tl.leaking_documents(spark, table, items).collect()))
    monkeypatch.setattr(tl, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, tl.leaking_documents(spark, table, items).collect())) == want and len(want) == 5


def test_every_occurrence_is_checked_by_itself(spark):
    rng = random.Random(12)
    item = ITEMS[0][1]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    one = item.replace("60", "85").replace("Boston", "Denver").replace("Alice", "Robert").replace(" 3 ", " 7 ")
    two = item.replace("60", "40").replace("Boston", "Dallas").replace("Alice", "Susan").replace(" 3 ", " 9 ")
    words = one.split()
    broken = " ".join(words[:14]) + " " + prose(rng, 30) + " " + " ".join(words[14:])
    texts = [item + " " + one, one + " " + prose(rng, 40) + " " + two, item + " " + broken, item + " " + one + " " + two, prose(rng, 80)]
    got = [r["doc_id"] for r in tl.leaking_documents(spark, docs(spark, texts), items).collect()]
    assert sorted(got) == [0, 1, 2, 3]
    box = "the box holds 1 red balls and 2 blue balls and 3 green balls and also 4 white balls in all of it"
    items = spark.createDataFrame([(1, box.replace("1", "5").replace("2", "5").replace("3", "5").replace("4", "5"))], "item_id long, text string")
    assert tl.leaking_documents(spark, docs(spark, [box, box + " " + box]), items).count() == 0


def test_items_full_of_numbers_are_found_as_they_stand(spark):
    rng = random.Random(13)
    sums = "Compute 12 + 7 - 3 * 4 / 2"
    tail = "Add 11 22 33 44 55 66 77 88 99 then tell the class which of these figures you would leave out"
    items = spark.createDataFrame([(1, sums), (2, tail)], "item_id long, text string")
    texts = [prose(rng, 20) + " " + sums + " " + prose(rng, 20), "Compute 12 + 7 - 3 * 4 / 5", tail, tail.replace("11", "13").replace("55", "57"), "add 11 22 33 44 55 66 77 88 99 now", prose(rng, 50)]
    got = {r["doc_id"]: r["item_id"] for r in tl.leaking_documents(spark, docs(spark, texts), items).collect()}
    assert got == {0: 1, 2: 2, 3: 2}


NUMBERS = tl.NUMBER_WORDS.split()
BLANK = r"[ \t\n\x0b\f\r]"
CAPITAL = tl.CAPITAL.replace("\\u2019", "\u2019")


def words_of(text):
    return [w for w in regex.split(BLANK + "+", regex.sub(r"[^\p{L}\p{M}\p{N} \t\n\x0b\f\r\ue000-\ue003]+", "", text.lower())) if w]


def template_of(text):
    """(tokens, values) of a text: placeholders, and what they stand for."""
    joined = regex.sub(rf"({CAPITAL}){BLANK}+(?=(?:\p{{Lu}}['\u2019])?\p{{Lu}}\p{{Ll}})", "\\1\ue003", text)
    named = regex.sub(rf"{CAPITAL}(?:\ue003{CAPITAL})*", "\ue002", joined)
    units = "|".join(tl.UNITS.split())
    slots = regex.sub(rf"{tl.FIGURES}({BLANK}+)(?:{units})(?![\p{{L}}\p{{N}}])", "\ue000\\1\ue001", named)
    tokens = ["\ue000" if w in NUMBERS else w for w in words_of(regex.sub(tl.FIGURES, "\ue000", slots))]
    return tokens, words_of(joined)


def slots_in(tokens):
    return sum(regex.search("[\ue000-\ue002]", t) is not None for t in tokens)


def brute_leaks(text, item):
    """Whether a text leaks an item, by all pairs of windows."""
    theirs, ours = words_of(text), words_of(item)
    if len(ours) < tl.LEAST_WORDS:
        return any(words_of(line) == ours for line in text.split("\n"))
    width = min(tl.WIDTH, len(ours))
    windows = {tuple(theirs[i : i + width]) for i in range(len(theirs) - width + 1)}
    n = len(ours) - width + 1
    if sum(tuple(ours[i : i + width]) in windows for i in range(n)) >= tl.COVERAGE * n:
        return True
    (own, values), (tokens, found) = template_of(item), template_of(text)
    width = min(tl.WIDTH, len(own))
    if len(own) < tl.LEAST_WORDS:
        return False
    usable = [i for i in range(len(own) - width + 1) if 2 * slots_in(own[i : i + width]) <= width]
    at = defaultdict(list)
    for i in usable:
        at[tuple(own[i : i + width])].append(i)
    places = [(pos, i) for pos in range(len(tokens) - width + 1) for i in at.get(tuple(tokens[pos : pos + width]), ())]
    if not usable or len({i for _, i in places}) < tl.COVERAGE * len(usable):
        return False
    if not any(slots_in(own[i : i + width]) for _, i in places):
        return True
    ways = defaultdict(list)
    ways[0] = places
    run = -1
    for k, (pos, i) in enumerate(sorted(places)):
        before = sorted(places)[k - 1] if k else None
        run += before is None or i < before[1] or (i == before[1] and pos > before[0])
        ways[1, run].append((pos, i))
    near, before = -1, None
    for pos, i in sorted(places, key=lambda x: x[0] - x[1]):
        near += before is None or pos - i - before > min(tl.WIDTH, (len(usable) + width - 1) // 2)
        before = pos - i
        ways[2, near].append((pos, i))
    for own_places in ways.values():
        if len({i for _, i in own_places}) < tl.COVERAGE * len(usable):
            continue
        choice = defaultdict(Counter)
        for pos, i in own_places:
            for k in range(width):
                if slots_in([own[i + k]]):
                    choice[own[i + k], values[i + k]][found[pos + k]] += 1
        top, total = sum(max(c.values()) for c in choice.values()), sum(sum(c.values()) for c in choice.values())
        if not total or top >= tl.AGREEMENT * total:
            return True
    return False


QUESTIONS = [
    "Alice has 3 apples. Tom has 4 pears.",
    "Maria Lopez and Ann O'Neil walk 5 km to the market and buy seven red apples there.",
    "Which planet is the largest one",
    "The quick heron stood in the shallow water near the old mill and watched small fish go by until dusk.",
    "Compute 12 + 7 - 3 * 4 / 2",
    "yes or no",
    "Bob reads 20 pages a day for 3 weeks. How many pages does Bob read in all if he rests on two days?",
]


def test_same_as_comparing_all_windows(spark):
    rng = random.Random(14)
    names, values = ["Sue", "Kim", "Bob", "Jean Paul Roy", "D'Arcy"], ["9", "14", "two", "12.5"]

    def changed(q):
        q = regex.sub(r"Maria Lopez|Ann O'Neil|Alice|Tom|Bob", lambda m: rng.choice(names) if rng.random() < 0.7 else m[0], q)
        q = regex.sub(r"\b(?:[0-9]+|seven|two)\b", lambda m: rng.choice(values) if rng.random() < 0.7 else m[0], q)
        words = q.split(" ")
        if rng.random() < 0.4:
            del words[rng.randrange(len(words))]
        return " ".join(words)

    texts = []
    for _ in range(260):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [changed(rng.choice(QUESTIONS)), rng.choice([" ", "\n", ". "]) + prose(rng, rng.randint(0, 20))]
        texts.append(rng.choice(["", "\n", " "]).join(parts))
    items = spark.createDataFrame(list(enumerate(QUESTIONS)), "item_id long, text string")
    got = defaultdict(set)
    for r in tl.leaks(spark, docs(spark, texts), items).collect():
        got[r["doc_id"]].add(r["item_id"])
    for i, t in enumerate(texts):
        assert got[i] == {k for k, q in enumerate(QUESTIONS) if brute_leaks(t, q)}, t
    assert sum(map(len, got.values())) > 60


def test_same_on_the_drivers_tables(spark):
    where = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()
    items = [r["text"] or "" for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    grams = [set(zip(*(words_of(q)[i:] for i in range(3)))) | set(zip(*(template_of(q)[0][i:] for i in range(3)))) for q in items]
    want = set()
    for r in texts:
        text = r["text"] or ""
        own = set(zip(*(words_of(text)[i:] for i in range(3)))) | set(zip(*(template_of(text)[0][i:] for i in range(3))))
        if any(not own.isdisjoint(g) and brute_leaks(text, q) for q, g in zip(items, grams)):
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in tl.op6_decontaminate(spark, where).collect()} == want and len(want) > 10


def test_names_numbers_and_short_items(spark):
    items = spark.createDataFrame(list(enumerate(QUESTIONS)), "item_id long, text string")
    texts = ["Bob has 5 apples. Sue has 9 pears.", "Kim and Bob walk 8 miles to the market and buy two red apples there.", "which planet is the largest one", "so:\n Yes, or no!\nwell", "yes or no, who knows"]
    rows = tl.leaking_documents(spark, docs(spark, texts), items).collect()
    assert {r["doc_id"]: r["item_id"] for r in rows} == {0: 0, 1: 1, 2: 2, 3: 5}
    assert {r["doc_id"] for r in rows if r["n_slots"] > 0} == {0, 1}


def test_a_repeated_window_null_ids_and_long_texts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(15)
    item = QUESTIONS[3]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    part = " ".join(item.split()[:9]) + " "
    texts = [part * 20_000, prose(rng, 60_000, 5000) + " " + item, item, item]
    table = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 2, F.col("doc_id")))
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in tl.leaking_documents(spark, table, items).collect())
    assert got == [("1", 1), ("None", 1)]


def test_variants_of_one_question_are_one_class(spark):
    questions = [f"A baker sells {i} loaves in the morning and {i + 3} loaves later, how many loaves did the baker sell" for i in range(300)]
    items = spark.createDataFrame(list(enumerate(questions)), "item_id long, text string")
    bench = tl.benchmark_windows(items)
    assert bench.where("not literal").select("item_id").distinct().count() <= 4
    got = tl.leaking_documents(spark, docs(spark, [questions[250], questions[7].replace("7", "7000")]), items).collect()
    assert {r["doc_id"] for r in got} == {0, 1} and all(r["n_items"] <= 8 for r in got)


def test_long_runs_do_not_exhaust_the_stack(spark):
    titles, figures, hyphens = " ".join(["Alice"] * 5000), ",".join(["12"] * 5000), "Alice" + "-Bob" * 5000
    frame = docs(spark, [f"They saw {titles} there", f"They saw {figures} km there", f"They saw {hyphens} there"])
    found = {r["doc_id"]: r["t"] for r in frame.select("doc_id", tl.template_tokens(F.col("text")).alias("t")).collect()}
    assert [found[i] for i in sorted(found)] == [[tl.NAME, "saw", *mid, "there"] for mid in ([tl.NAME], [tl.NUMBER, tl.UNIT], [tl.NAME])]
