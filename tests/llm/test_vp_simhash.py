import random

import numpy as np
import xxhash

from tests.llm.helpers import LOW, WORDS, docs, prose, with_clashes
from tessera.llm import vp_simhash as vs
from tessera.llm.components import components


def brute_fingerprint(text):
    words = WORDS.findall((text or "").translate(LOW))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_the_definition():
    rng = random.Random(12)
    for t in ["", "  ", "A", "a B", "Ä É x y", "a\x1cb c\xa0d e", prose(rng, 50), prose(rng, 3000)]:
        assert vs.fingerprint(t.encode()) == brute_fingerprint(t)


def planted(rng, n):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    near = [b ^ np.uint64((1 << rng.integers(0, 64)) | (1 << rng.integers(0, 64))) for b in base[: n // 3] for _ in range(2)]
    return np.unique(np.concatenate([base, np.array(near, np.uint64)]))


def test_tree_and_leaf_search_lose_no_pair(monkeypatch):
    monkeypatch.setattr(vs, "LEAF", 16)
    fps = planted(np.random.default_rng(1), 600)
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 2]}
    local = {(int(x), int(y)) for a, b in vs.links_within(fps, fps, 2) for x, y in zip(a, b)}
    assert local == want and len(want) > 100
    tree = vs.build(fps[::3], 5)
    at, leaf, home = tree.route(fps, 2)
    assert home.sum() == len(fps)
    found = set()
    for one in np.unique(leaf):
        own = leaf == one
        found |= {(int(x), int(y)) for a, b in vs.links_within(np.unique(fps[at[own & home]]), np.unique(fps[at[own]]), 2) for x, y in zip(a, b)}
    assert found == want


def test_components_follow_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(spark, edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 150 and len(got) == 45
    assert components(spark, edges.limit(0)).count() == 0


def test_few_edges_are_labelled_in_one_task_as_in_rounds(spark):
    rng = np.random.default_rng(17)
    pairs = [*rng.integers(-300, 300, (260, 2)).tolist(), *[(i, i + 1) for i in range(1000, 1040)], *[(3000 - i, 2000) for i in range(30)], (7, 7)]
    edges = spark.createDataFrame([tuple(p) for p in pairs], "a long, b long")
    want = sorted(map(tuple, components(spark, edges).collect()))
    assert sorted(map(tuple, components(spark, edges, 10**6).collect())) == want
    assert sorted(map(tuple, components(spark, edges, 5).collect())) == want
    assert components(spark, edges.limit(0), 10**6).count() == 0


def test_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vs, "LEAF", 8)
    rng = random.Random(13)
    texts = [prose(rng, rng.choice([1, 2, 5, 40, 400])) for _ in range(60)]
    texts += [texts[5], texts[5].upper(), texts[20] + " tail", None, "", " \n", texts[7]]
    table = docs(spark, texts)
    f = [brute_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (f[i] ^ f[j]).bit_count() <= 2:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in vs.near_duplicates(spark, with_clashes(table)).collect()}
    assert got == {i: (f[i], parent[i]) for i in range(len(texts))}
    twice = table.unionByName(table.limit(3)).unionByName(spark.createDataFrame([(None, "lost words here", "en", "s", 1)], table.schema))
    assert vs.near_duplicates(spark, twice).count() == len(texts) + 4
    assert vs.near_duplicates(spark, table.limit(0)).count() == 0


def test_sharded_leaves_lose_no_link(spark, monkeypatch):
    fps = planted(np.random.default_rng(5), 900)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    groups = []
    for shard in (1 << 18, 100):
        monkeypatch.setattr(vs, "SHARD", shard)
        monkeypatch.setattr(vs, "LEAF", 300)
        links = vs.link(spark, table)
        groups.append(sorted(map(tuple, components(spark, links).collect())))
    assert groups[0] == groups[1] and len(groups[0]) > 200
    dealt = spark.createDataFrame([(0, int(x), True) for x in fps.view(np.int64)], "leaf long, fp long, home boolean")
    assert vs.sharded(spark, dealt).groupBy("leaf", "i", "j").count().agg({"count": "max"}).first()[0] < 2 * 100 * 1.6
