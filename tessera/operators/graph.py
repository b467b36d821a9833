"""Cell graphs: nearest neighbours of nuclei within an image, node features, augmentation variants."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the distance matrix that are held at a time.
BLOCK = 512


def nearest(points: np.ndarray, ids: np.ndarray, k: int, limit: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, dist) of the k nearest others, ties by id; points must be sorted by id. Squared distances are summed axis by axis."""
    out = []
    n = len(points)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    take = min(k, n - 1)
    for at in range(0, n, BLOCK):
        rows = np.arange(at, min(n, at + BLOCK))
        d = np.zeros((len(rows), n))
        for axis in range(points.shape[1]):
            diff = points[rows, axis][:, None] - points[None, :, axis]
            d += diff * diff
        d[np.arange(len(rows)), rows] = np.inf
        bound = np.partition(d, take - 1, axis=1)[:, take - 1]
        i, j = np.nonzero(d <= bound[:, None])
        order = np.lexsort((ids[j], d[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < take
        out.append((ids[rows[i[keep]]], ids[j[keep]], np.sqrt(d[i[keep], j[keep]])))
    src, dst, dist = (np.concatenate(x) for x in zip(*out))
    if limit is not None:
        near = dist <= limit
        src, dst, dist = src[near], dst[near], dist[near]
    return src, dst, dist


def knn_edges(nodes: DataFrame, k: int = 5, limit: float | None = None, image: str = "image", node: str = "node", position: str = "position") -> DataFrame:
    """image, src, dst, dist of the k nearest nodes of every node within its image, ties by id, at most ``limit`` away.

    One task holds one image's nodes and a strip of their distances.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        points = np.array(group["position"].tolist(), float)
        src, dst, dist = nearest(points, group["node"].to_numpy(), k, limit)
        return pd.DataFrame({"image": group["image"].iloc[0], "src": src, "dst": dst, "dist": dist})

    rows = nodes.select(F.col(image).cast("long").alias("image"), F.col(node).cast("long").alias("node"), F.col(position).cast("array<double>").alias("position"))
    return rows.groupBy("image").applyInPandas(run, "image long, src long, dst long, dist double")


def with_location(nodes: DataFrame, width: str, height: str) -> DataFrame:
    """Node features with the centroid, as shares of the image's width and height, appended."""
    place = F.array(F.col("cx") / F.col(width), F.col("cy") / F.col(height))
    return nodes.withColumn("features", F.concat(F.col("features").cast("array<double>"), place))


def variants(spark: SparkSession, rotations: Sequence[int] = (0,), flips: Sequence[str] = ("n",)) -> DataFrame:
    """angle, flip: every rotation with every flip (n none, h horizontal, v vertical)."""
    unknown = set(flips) - {"n", "h", "v"}
    if unknown:
        raise ValueError(f"unknown flips {sorted(unknown)}")
    angles = spark.createDataFrame([(int(a),) for a in rotations], "angle int")
    return angles.crossJoin(spark.createDataFrame([(f,) for f in flips], "flip string"))


def graphs(nodes: DataFrame, variant: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """The nodes and edges of every image with nuclei; images without one have no graph. Variants multiply the nodes' features only."""
    return {"nodes": nodes.crossJoin(F.broadcast(variant)), "edges": knn_edges(nodes, k)}
