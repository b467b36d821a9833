"""Connected components of an edge table by alternating large-star and small-star rounds, or in one task where edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, a, b = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)  # every root goes to the smallest beside it
        while (label != (up := label[label])).any():
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)
        node, root = labels(*(np.concatenate([np.zeros(0, np.int64), *(x.column(i).to_numpy() for x in batches)]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])
        common.trim_memory()

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(spark: SparkSession, edges: DataFrame, alone: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b of type long); root is the smallest node of its component.

    Self-loops and repeated edges are ignored. Each round is written to the shared checkpoint folder; the number of
    rounds grows with the logarithm of the longest chain. No edge list reaches the driver. Up to ``alone`` edges are
    labelled in one task instead, which saves the driver the rounds' plans.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = common.cut_lineage(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if alone and now.count() <= alone:
        return common.cut_lineage(spark, _in_one_task(now))
    mark = state(now)
    while mark[0]:
        after = common.cut_lineage(spark, _small_star(_large_star(now)))
        if (new := state(after)) == mark:
            break
        now, mark = after, new
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
