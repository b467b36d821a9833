import random

import numpy as np

from tests.llm.helpers import docs, prose
from tessera.llm import near_copies as nc


def edited(rng, text, times):
    words = text.split()
    for i in rng.sample(range(len(words)), times):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """The smallest position in the group of every text, over all pairs."""
    sets, root = [shingle_set(t or "") for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def corpus(rng):
    base = [prose(rng, rng.randint(20, 300)) for _ in range(30)]
    line = prose(rng, 40)
    texts = list(base)
    texts += [edited(rng, t, max(1, len(t.split()) * k // 100)) for t in base for k in (1, 2, 3, 5)]
    texts += [edited(rng, base[0], 1 + i % 4) for i in range(40)]  # a large group, not all of it similar to one centre
    texts += [prose(rng, 30) + " " + line for _ in range(40)]  # one hot line
    return texts + [None, "", "a b", "A  b", "a b c d", line]


def test_groups_match_all_pairs(spark, monkeypatch):
    rng = random.Random(31)
    texts = corpus(rng)
    want = brute(texts)
    for often in (nc.OFTEN, 10**9):
        monkeypatch.setattr(nc, "OFTEN", often)
        rows = {r["doc_id"]: r["component"] for r in nc.groups(spark, docs(spark, texts)).collect()}
        first = {}
        assert [first.setdefault(rows[i], i) for i in range(len(texts))] == want
    assert nc.groups(spark, docs(spark, texts).limit(0)).count() == 0


def test_shingles_that_the_same_texts_share_are_one_list(spark):
    rng = random.Random(5)
    base = [prose(rng, 300) for _ in range(4)]
    texts = [t for b in base for t in (b, b + " tail", b + " other end")]
    rows = nc.nodes(spark, docs(spark, texts), np.zeros(0, np.uint64))
    found = nc.postings(spark, rows).collect()
    shared = {}
    for r in rows.collect():
        for s in r["prefix"]:
            shared.setdefault(s, set()).add(r["key"])
    shared = {s: frozenset(k) for s, k in shared.items() if len(k) > 1}
    lists = {}
    for r in found:
        lists.setdefault((r["s"], r["times"]), set()).add(r["key"])
    assert len(lists) == len(set(shared.values())) < len(shared) / 4
    assert {frozenset(k): times for (_, times), k in lists.items()} == {k: list(shared.values()).count(k) for k in set(shared.values())}


def test_only_lists_with_texts_of_several_groups_are_searched(spark):
    named = spark.createDataFrame([(1, 10, 3, 10), (1, 11, 3, 10), (2, 10, 2, 10), (2, 12, 2, 12), (3, 11, 5, 10), (3, 12, 5, 12), (3, 13, 5, 13)], "s long, key long, times long, root long")
    rows = nc.contested(named).select("s", "key", "own").collect()
    assert sorted(map(tuple, rows)) == [(2, 10, 2), (2, 12, 7), (3, 11, 5), (3, 12, 7), (3, 13, 5)]
    assert "Join" not in nc.contested(named)._jdf.queryExecution().optimizedPlan().toString()  # the lists' rows are read once, and none is made twice


def test_parities_rule_out_most_pairs_and_no_link(spark):
    rng = np.random.default_rng(3)
    sets, pairs = [], {}
    for k in range(60):
        n = int(rng.integers(1, 900))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = a.copy()
        b[: (n * (k % 30)) // 60] += np.uint64(1)  # similarities from 0.3 to 1
        x, y = set(a.tolist()), set(b.tolist())
        pairs[2 * k, 2 * k + 1] = len(x & y) / len(x | y)
        sets += [(2 * k, a), (2 * k + 1, b)]
    table = spark.createDataFrame([(k, s.view(np.int64).tolist(), nc.parities_of(s).tolist()) for k, s in sets], "key long, own array<long>, parities array<long>")
    found = {tuple(r) for r in nc.possible(spark.createDataFrame(list(pairs), "a long, b long"), table).collect()}
    assert {p for p, j in pairs.items() if j >= 0.8} <= found
    assert not [p for p in found if pairs[p] < 0.6]
