"""Grid tiling of annotations: one row a tile, kept by its share of overlap with the annotation.

Tiles start at the annotation's bounds and step by size less overlap, x outside, y inside. With ``full_coverage`` a tile stays if the
annotation covers at least ``share`` of it; without, every tile of the bounding box stays. Annotations whose label isn't tiled pass through.
The generator runs inside the row, so tiling needs no join and no shuffle. Rectangles never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import polygons


def starts(low: Column, high: Column, step: int) -> Column:
    """low, low + step, ... below high; empty if there is none (sequence would count down)."""
    return F.when(high > low, F.sequence(low, high - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def check_step(size: int, overlap: int) -> int:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and less than the tile size {size}")
    return size - overlap


def tile_rectangles(boxes: DataFrame, size: int, overlap: int = 0, share: float = 0.2, full_coverage: bool = False, only_intersection: bool = False, labels: Sequence[str] | None = None, ratio: float = 1) -> DataFrame:
    """Tiles of integer boxes (x1, y1, x2, y2): the boxes' other columns, x, y, size, inter (overlap area).

    ``only_intersection`` adds the clipped corners ix1, iy1, ix2, iy2 and drops tiles without overlap. With ``labels``, rows of other labels come back once,
    with null tile columns.
    """
    size, overlap = int(size * ratio), int(overlap * ratio)
    step = check_step(size, overlap)
    tiled = boxes if labels is None else boxes.where(F.col("label").isin(*labels))
    x1, y1, x2, y2 = (F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2"))
    grid = tiled.withColumn("x", F.explode(starts(x1, x2, step))).withColumn("y", F.explode(starts(y1, y2, step)))
    ix1, iy1 = F.greatest("x", x1), F.greatest("y", y1)
    ix2, iy2 = F.least(F.col("x") + size, x2), F.least(F.col("y") + size, y2)
    inter = F.greatest(F.lit(0).cast("long"), ix2 - ix1) * F.greatest(F.lit(0).cast("long"), iy2 - iy1)
    out = grid.withColumn("size", F.lit(size)).withColumn("inter", inter)
    if full_coverage:
        out = out.where(F.col("inter") >= share * size * size)
    if only_intersection:
        out = out.where(F.col("inter") > 0).withColumns({"ix1": ix1, "iy1": iy1, "ix2": ix2, "iy2": iy2})
    if labels is not None:
        out = out.unionByName(boxes.where(~F.col("label").isin(*labels) | F.col("label").isNull()), allowMissingColumns=True)
    return out


def with_centres(tiles: DataFrame) -> DataFrame:
    """Adds cx, cy, the centres of the tiles."""
    return tiles.withColumns({"cx": F.col("x") + F.col("size") / 2, "cy": F.col("y") + F.col("size") / 2})


RING = "array<struct<x:double,y:double>>"


def tile_polygons(annotations: DataFrame, size: int, overlap: int = 0, share: float = 0.2, full_coverage: bool = False) -> DataFrame:
    """Tiles of polygons (id, label, rings: array of rings, the first the exterior): id, label, x, y, size, covered, mask_rings.

    ``mask_rings`` are the exteriors of the clipped parts; holes lower the coverage only. Bounds are the exterior's, cut to whole pixels.
    """
    step = check_step(size, overlap)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring_type = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), ring_type)
        for batch in it:
            out = []
            for i, label, rings in zip(*(batch.column(c).to_pylist() for c in range(3))):
                points = [[(p["x"], p["y"]) for p in r] for r in rings or ()]
                if not points or len(points[0]) < 3:
                    continue
                xs, ys = zip(*points[0])
                across, down = (range(floor(min(v)), ceil(max(v)), step) for v in (xs, ys))
                columns = [polygons.clipped_columns(r, across, size) for r in points]
                for x in across:
                    for y in down:
                        part = polygons.clipped_rows(columns[0][x], y, size)
                        covered = polygons.ring_area(part)
                        for hole in columns[1:]:
                            covered -= polygons.ring_area(polygons.clipped_rows(hole[x], y, size))
                        covered /= size * size
                        if not full_coverage or covered >= share:
                            masks = [part] if 3 <= len(part) < 6 else [list(map(tuple, m.tolist())) for m in polygons.parts(np.array(part, float).reshape(-1, 2))]
                            out.append((i, label, x, y, size, covered, [[{"x": a, "y": b} for a, b in m] for m in masks]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names=["id", "label", "x", "y", "size", "covered", "mask_rings"])

    # rings are small beside their tiles: dealing them out evenly costs little and fills the cores
    dealt = annotations.select("id", "label", "rings").repartition(2 * annotations.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"id long, label string, x long, y long, size int, covered double, mask_rings array<{RING}>")
