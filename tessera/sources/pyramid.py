"""Slide pyramids stored as tables of cells, and the reading of regions from them.

A pyramid is a table (file_key, level, row, col, image) of cells of ``cell`` pixels, as any decoder can write it once. A request names a slide, a centre in
pixels of the finest level, a size and a spacing; it reads the cells of the chosen level that its region touches, by equi-join, never a
finer level than needed, and assembles one patch a request. Requests are one row a resolution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import images
from tessera.functions.pyramid import MARGIN, chosen_level, read_size


def per_resolution(samples: DataFrame, spacing: str = "spacing") -> DataFrame:
    """One row a sample and resolution, from a map of spacings; resolutions without a spacing are left out. Raises nothing: a sample without any has no row."""
    return samples.select("*", F.explode(F.map_filter(spacing, lambda _, v: v.isNotNull())).alias("resolution", "wanted")).drop(spacing)


def planned(requests: DataFrame, slides: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Adds level, real (spacing), rescale, read_width, read_height, ratio (real to finest spacing), left and top (pixels of the level) to requests
    (request, file_key, x, y, width, height, wanted). read_width is null where the level can't serve the request."""
    rows = requests.join(slides.select("file_key", "spacings"), "file_key").withColumn("_c", chosen_level(F.col("spacings"), F.col("wanted"), margin))
    rows = rows.withColumns({"level": F.col("_c.level"), "rescale": F.col("_c.rescale")}).withColumn("real", F.get("spacings", F.col("level")))
    size = lambda c: read_size(F.col(c), F.col("wanted"), F.col("real"), F.col("rescale"))
    rows = rows.withColumns({"read_width": size("width"), "read_height": size("height"), "ratio": F.col("real") / F.get("spacings", F.lit(0))})
    corner = lambda c, s: F.floor(F.col(c) / F.col("ratio") - F.floor(F.col(s) / F.lit(2)))
    return rows.withColumns({"left": corner("x", "read_width"), "top": corner("y", "read_height")}).drop("_c", "spacings")


def read_regions(plan: DataFrame, cells: DataFrame, cell: int, outside: int = 230) -> DataFrame:
    """request, resolution and patch (the image struct) for every served request of a plan; what lies outside the slide is constant."""
    last = lambda at, n: F.floor((F.col(at) + F.col(n) - 1) / cell)
    wanted = plan.where("read_width > 0 and read_height > 0")
    touched = wanted.withColumn("row", F.explode(F.sequence(F.floor(F.col("top") / cell), last("top", "read_height")))).withColumn("col", F.explode(F.sequence(F.floor(F.col("left") / cell), last("left", "read_width"))))
    found = touched.join(cells.select("file_key", "level", "row", "col", "image"), ["file_key", "level", "row", "col"], "left")

    names = ["request", "resolution", "top", "left", "read_height", "read_width", "height", "width", "rescale", "row", "col", "image"]

    def patch_of(rows: list[tuple]) -> dict:
        _, _, top, left, read_height, read_width, height, width, rescale, *_ = rows[0]
        parts = [(r[9], r[10], images.decoded(r[11])) for r in rows]
        depth = next((p.shape[2] for _, _, p in parts if p is not None), 3)
        patch = np.full((read_height, read_width, depth), outside, np.uint8)
        for row, col, image in parts:
            if image is None:
                continue
            y, x = row * cell - top, col * cell - left
            y0, x0, y1, x1 = max(0, y), max(0, x), min(read_height, y + image.shape[0]), min(read_width, x + image.shape[1])
            if y1 > y0 and x1 > x0:
                patch[y0:y1, x0:x1] = image[y0 - y : y1 - y, x0 - x : x1 - x]
        return images.encoded(images.resized(patch, height, width) if rescale else patch)

    def assemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.string(), kind))], names=["request", "resolution", "patch"])

        for batch in it:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if own and own[0][:2] != r[:2]:
                    out.append((*own[0][:2], patch_of(own)))
                    own = []
                own.append(r)
            yield batch_of(out)
        if own:
            yield batch_of([(*own[0][:2], patch_of(own))])

    dealt = found.select(*names).repartition("request", "resolution").sortWithinPartitions("request", "resolution")
    return dealt.mapInArrow(assemble, f"request long, resolution string, patch {images.IMAGE}")


def thumbnails(slides: DataFrame, cells: DataFrame, spacing: float, margin: float = MARGIN) -> DataFrame:
    """file_key, level, real (its spacing) and image: the whole level that serves a coarse spacing, put together from its cells."""
    known = slides.withColumn("_c", chosen_level(F.col("spacings"), F.lit(float(spacing)), margin))
    known = known.select("file_key", F.col("_c.level").alias("level"), F.get("spacings", F.col("_c.level")).alias("real"))

    def assemble(group: pd.DataFrame) -> pd.DataFrame:
        parts = {(int(r), int(c)): images.decoded(i) for r, c, i in zip(group["row"], group["col"], group["image"])}
        rows, cols = (sorted({k[axis] for k in parts}) for axis in (0, 1))
        whole = np.concatenate([np.concatenate([parts[r, c] for c in cols], axis=1) for r in rows])
        first = group.iloc[0]
        return pd.DataFrame([{"file_key": first["file_key"], "level": first["level"], "real": first["real"], "image": images.encoded(whole)}])

    found = known.join(cells, ["file_key", "level"])  # a coarse level is a few cells
    return found.groupBy("file_key").applyInPandas(assemble, f"file_key string, level int, real double, image {images.IMAGE}")


def tissue_masks(thumbnail: DataFrame, white: int = 220) -> DataFrame:
    """Thumbnails with a mask of one channel: 255 where some channel is darker than background."""
    return images.map_images(thumbnail, lambda im, _: None if im is None else (im.min(axis=2, keepdims=True) < white).astype(np.uint8) * 255, key="file_key")
