"""Facades that wire listings, tiling, statistics and samplers into one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import samplers, stats, tiles


@dataclass(frozen=True)
class BatchPlan:
    """The tables of a batch sampler: batches in order, references by label, counts by label, and the batch's shape."""

    samples: DataFrame
    references: DataFrame
    counts: DataFrame
    shape: dict[str, tuple[float, int, int]]


def create_batch_sampler(annotations: DataFrame, labels: list[str], spacings: dict[str, float | None], tile: int = 512, stride_overlap: float = 0.0, share: float = 0.2, batch: int = 32, seed: int = 123, ordered: bool = False) -> BatchPlan:
    """Tiles the annotations (id, file_key, label, x1, y1, x2, y2) of the labels and lists every tile once, label after label, in batches.

    Samples carry the tile's centre and one row a resolution's spacing is the caller's explode away (``sources.pyramid.per_resolution``).
    """
    wanted = {k: s for k, s in spacings.items() if s is not None}
    if "target" not in wanted:
        raise ValueError("a target spacing is required")
    grid = tiles.tile_rectangles(annotations.where(F.col("label").isin(*labels)), tile, int(tile * stride_overlap), share, full_coverage=True)
    references = tiles.with_centres(grid).withColumn("tile", F.concat_ws("/", F.lpad(F.col("id").cast("string"), 12, "0"), F.lpad(F.col("x").cast("string"), 9, "0"), F.lpad(F.col("y").cast("string"), 9, "0")))
    dimension = annotations.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counts = stats.per(references, ["label"], dimension, F.lit(1), "n_tiles")
    drawn = samplers.one_time_batches(references, "tile", "label", batch, None if ordered else seed)
    samples = drawn.join(references.select("tile", "file_key", "cx", "cy"), "tile")
    return BatchPlan(samples, references, counts, {k: (s, tile, tile) for k, s in wanted.items()})
