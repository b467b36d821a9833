"""Resolution arithmetic of image pyramids, as columns.

``spacings`` is an array column: micrometres a pixel by level, ascending. The margin within which a level counts as the one asked for
is a share of the requested spacing; of two levels equally near, the finer one is taken.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the requested spacing.
MARGIN = 0.3


def nearest_level(spacings: Column, wanted: Column) -> Column:
    """The level of the nearest spacing, the lower one of two."""
    distances = F.transform(spacings, lambda s, i: F.struct(F.abs(s - wanted).alias("d"), i.alias("level")))
    return F.array_min(distances)["level"]


def chosen_level(spacings: Column, wanted: Column, margin: float = MARGIN) -> Column:
    """struct(level, rescale): outside the margin the next finer level is read and rescaled."""
    near = nearest_level(spacings, wanted)
    real = F.get(spacings, near)
    outside = F.abs(real - wanted) > wanted * margin
    level = F.when(outside & (real > wanted), near - 1).otherwise(near)
    return F.struct(F.greatest(level, F.lit(0)).alias("level"), outside.alias("rescale"))


def read_size(size: Column, wanted: Column, real: Column, rescale: Column) -> Column:
    """Pixels to read for ``size`` pixels at the wanted spacing; null where the level is too coarse to be scaled down."""
    return F.when(~rescale, size.cast("long")).when(wanted / real > 1, F.floor(size * (wanted / real)).cast("long"))


def mask_ratio(spacing: Column, finest: Column) -> Column:
    return spacing / finest


def details(width: Column, height: Column, target: Column, fine: Column) -> Column:
    """struct(n, total_i, total_j, target, details) of the detail patches of a tile; null unless they divide it evenly.

    ``target`` and ``fine`` are downsampling factors.
    """
    factor = target.cast("int") / fine.cast("int")
    w, h = F.floor(width / factor).cast("int"), F.floor(height / factor).cast("int")
    whole = (w > 0) & (h > 0) & (width % w == 0) & (height % h == 0)
    across, down = F.floor(width / w).cast("int"), F.floor(height / h).cast("int")
    found = F.struct((across * down).alias("n"), across.alias("total_i"), down.alias("total_j"), target.alias("target"), fine.alias("details"))
    return F.when(whole, found)
