"""SimHash near-duplicates, linked exactly through a vantage-point tree over Hamming distance.

A document's fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 values (seed 42) of the
document's 3-word shingles. Distinct fingerprints are dealt to the leaves of a vantage-point tree: each inner node holds
a vantage fingerprint and a radius, and a fingerprint lives on one side of it. A query also visits the other side
where the triangle inequality cannot exclude a partner: d(q, v) - r <= t < d(q, v) + r. So every pair within r meets in the
home leaf of its larger fingerprint. The tree is fitted on a bounded sample of fingerprints, which only sets its
shape; every fingerprint is indexed. A leaf is searched by a tree of its own, as deep as it needs. Leaves of more than ``SHARD`` fingerprints, at home or visiting, are dealt by hash into
home shards and query shards, and every home shard meets every query shard in a task of its own, so that no task holds more than about 2 SHARD fingerprints however many there are.
Leaves emit spanning links, not all pairs, and components are found on distinct fingerprints, so a group of copies,
however large, is one node.

Nulls: a null text is empty; texts without words have fingerprint zero. A null id gets a fingerprint and a component, but is
never a component's id unless all its ids are null. Repeated rows are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import components

LEAF = 2048
#: Fingerprints that shape the tree, on average, and its greatest depth: at most 2**17 nodes are broadcast.
SAMPLE, MAX_DEPTH = 100_000, 16
#: Fingerprints of a leaf that one task holds.
SHARD = 1 << 18


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The fingerprint of a text in UTF-8."""
    words = raw.lower().split()  # on bytes: A-Z only, and white space 0x20, 0x09-0x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), 42)
    bits, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 65_536):
        part = words[at : at + 65_536 + width - 1]
        h = np.array([digest(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(width)))], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash that tells texts apart under one id) and fp, a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in common.bytes_of(batch.column(2))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "th", "fp"])

    text = F.col("text").cast("string")
    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text")), run, "doc_id long, th long, fp long")


@dataclass
class Tree:
    """Nodes in an implicit binary heap; a node without a vantage point is a leaf."""

    vantage: np.ndarray
    radius: np.ndarray
    inner: np.ndarray

    def route(self, fps: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, leaf, whether the leaf is its home) of every leaf that a fingerprint lives in or visits."""
        at, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        out = []
        while len(at):
            done = ~self.inner[node]
            if done.any():
                out.append((at[done], node[done], home[done]))
                at, node, home = at[~done], node[~done], home[~done]
                continue
            d, t = np.bitwise_count(fps[at] ^ self.vantage[node]).astype(np.int64), self.radius[node]
            near, far = d - slack <= t, d + slack > t
            at, node, home = np.concatenate([at[near], at[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2]), np.concatenate([home[near] & (d <= t)[near], home[far] & (d > t)[far]])
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (at, node, home)


def split_of(fps: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point of great spread and the radius nearest to an even split; None if nothing splits."""
    tries = fps[:: max(1, len(fps) // 8)][:8]
    d = np.bitwise_count(fps[None, :4096] ^ tries[:, None]).astype(np.int64)
    best = int(d.var(axis=1).argmax())
    counts = np.bincount(np.bitwise_count(fps ^ tries[best]), minlength=65).cumsum()
    radius = int(np.abs(counts[:-1] - len(fps) / 2).argmin())
    return (tries[best], radius) if 0 < counts[radius] < len(fps) else None


def build(sample: np.ndarray, depth: int) -> Tree:
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, bool))
    todo = [(0, sample)]
    while todo:
        node, own = todo.pop()
        if 2 * node + 2 >= size or len(own) < 8 or not (cut := split_of(own)):
            continue
        tree.vantage[node], tree.radius[node], tree.inner[node] = cut[0], cut[1], True
        inside = np.bitwise_count(own ^ cut[0]) <= cut[1]
        todo += [(2 * node + 1, own[inside]), (2 * node + 2, own[~inside])]
    return tree


def links_within(home: np.ndarray, queries: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query, home) with query < home and distance <= slack, in blocks; both inputs are sorted and distinct."""
    todo = [(home, queries)]
    while todo:
        home, queries = todo.pop()
        if not len(home) or not len(queries):
            continue
        if len(home) > 2 * LEAF and (cut := split_of(home)):
            dh, dq = np.bitwise_count(home ^ cut[0]).astype(np.int64), np.bitwise_count(queries ^ cut[0]).astype(np.int64)
            todo += [(home[dh <= cut[1]], queries[dq - slack <= cut[1]]), (home[dh > cut[1]], queries[dq + slack > cut[1]])]
            continue
        for at in range(0, len(queries), 256):
            q = queries[at : at + 256]
            h = home[np.searchsorted(home, q[0], "right") :]
            if len(h):
                i, j = np.nonzero(np.bitwise_count(q[:, None] ^ h[None, :]) <= slack)
                keep = q[i] < h[j]
                yield q[i[keep]], h[j[keep]]


def spanning(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kept = []
    for a, b in blocks:
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                kept.append((x, y))
    return kept


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def link(spark: SparkSession, fps: DataFrame, slack: int = 2) -> DataFrame:
    """Links (a, b) that span every component of the distinct fingerprints ``fps`` (fp) at distance <= slack."""
    n = fps.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / LEAF))))))
    shape = sorted(r["fp"] for r in common.hash_sample(fps.select("fp"), n, SAMPLE, "fp").collect()) if depth else []
    tree = spark.sparkContext.broadcast(build(np.array(shape, np.int64).view(np.uint64), depth))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at, leaf, home = tree.value.route(own, slack)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(signed(own[at]), pa.int64()), pa.array(home)], names=["leaf", "fp", "home"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        own, kind = group["fp"].to_numpy(np.int64).view(np.uint64), group["kind"].to_numpy()
        found = spanning(links_within(np.unique(own[kind != QUERY]), np.unique(own[kind != HOME]), slack))
        a, b = (np.array([x[i] for x in found], np.uint64) for i in (0, 1))
        return pd.DataFrame({"a": signed(a), "b": signed(b)})

    dealt = common.written(spark, fps.select("fp").mapInArrow(deal, "leaf long, fp long, home boolean"), "leaves")
    return sharded(spark, dealt).groupBy("leaf", "i", "j").applyInPandas(search, "a long, b long")


#: What a fingerprint is to a shard: at home, visiting, or both.
HOME, QUERY, BOTH = 0, 1, 2


def sharded(spark: SparkSession, dealt: DataFrame) -> DataFrame:
    """leaf, i (home shard), j (query shard), fp and kind; leaves of up to SHARD fingerprints are one shard."""
    sizes = dealt.groupBy("leaf").agg(F.count("*").alias("visits"), F.sum(F.col("home").cast("long")).alias("homes"))
    large = sizes.where(F.col("visits") > SHARD).select("leaf", F.ceil(F.col("homes") / SHARD).cast("int").alias("n"), F.ceil(F.col("visits") / SHARD).cast("int").alias("m"))  # at most a row a leaf
    rows = common.cut_lineage(spark, large)
    one = F.lit(0)
    if not rows.limit(1).count():
        return dealt.select("leaf", one.alias("i"), one.alias("j"), "fp", F.when(F.col("home"), BOTH).otherwise(QUERY).alias("kind"))
    both = dealt.join(F.broadcast(rows), "leaf", "left").withColumns({"n": F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)), "m": F.coalesce("m", F.lit(1))})
    whole = both.where("m = 1").select("leaf", one.alias("i"), one.alias("j"), "fp", F.when(F.col("home"), BOTH).otherwise(QUERY).alias("kind"))
    parts, own = both.where("m > 1"), lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    homes = parts.where("home").select("leaf", own("n").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), "fp", F.lit(HOME).alias("kind"))
    queries = parts.select("leaf", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), own("m").alias("j"), "fp", F.lit(QUERY).alias("kind"))
    return whole.unionByName(homes).unionByName(queries)


def near_duplicates(spark: SparkSession, docs: DataFrame, slack: int = 2) -> DataFrame:
    """doc_id, th, fp and component_id of every row."""
    common.prepare(spark)
    own = common.cut_lineage(spark, fingerprints(docs))
    fps = common.cut_lineage(spark, own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(spark, link(spark, fps, slack)).select(F.col("node").alias("fp"), "root")
    named = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "component_id"), "fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
