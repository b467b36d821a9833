"""Golden cases and invariants of tiling and resolution arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import polygons, pyramid
from tessera.operators import tiles


def box(spark, x1=0, y1=0, x2=10, y2=10, label="tumor"):
    return spark.createDataFrame([(1, label, x1, y1, x2, y2)], "id long, label string, x1 long, y1 long, x2 long, y2 long")


@pytest.mark.parametrize("share,n", [(0.2, 9), (0.25, 9), (0.3, 8), (0.5, 8), (0.6, 4), (1.0, 4)])
def test_tiles_kept_by_share(spark, share, n):
    assert tiles.tile_rectangles(box(spark), 4, 0, share, full_coverage=True).count() == n


@pytest.mark.parametrize("share,n", [(1.0, 16), (0.2, 25)])
def test_tiles_with_overlap(spark, share, n):
    assert tiles.tile_rectangles(box(spark), 4, 2, share, full_coverage=True).count() == n


def test_without_full_coverage_all_tiles_of_the_box_stay(spark):
    assert tiles.tile_rectangles(box(spark), 4, share=1.0).count() == 9
    assert tiles.tile_rectangles(box(spark, 5, 5, 5, 9), 4).count() == 0


def test_other_labels_pass_through(spark):
    rows = tiles.tile_rectangles(box(spark).unionByName(box(spark, label="other")).unionByName(box(spark, label=None)), 4, labels=["tumor"]).collect()
    assert len(rows) == 11 and sum(r["x"] is None for r in rows) == 2


def test_overlap_must_be_less_than_the_size(spark):
    for overlap in (4, 5, -1):
        with pytest.raises(ValueError):
            tiles.tile_rectangles(box(spark), 4, overlap)


def test_polygons_agree_with_rectangles(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = spark.createDataFrame([(1, "a", [[dict(x=x, y=y) for x, y in ring]]), (2, "b", None), (3, "c", [[dict(x=0.0, y=0.0)]])], "id long, label string, rings array<array<struct<x:double,y:double>>>")
    got = {(r["x"], r["y"], round(r["covered"] * 16)) for r in tiles.tile_polygons(rows, 4, 0, 0.2, True).collect()}
    want = {(r["x"], r["y"], r["inter"]) for r in tiles.tile_rectangles(box(spark), 4, 0, 0.2, True).collect()}
    assert got == want


def test_clipping_area_of_a_concave_ring():
    u = np.array([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)], float)
    clipped = polygons.clip(u, 0, 3, 6, 6)
    assert abs(polygons.area(clipped) - 12.0) < 1e-9
    assert sorted(round(polygons.area(p), 6) for p in polygons.parts(clipped)) == [6.0, 6.0]
    hole = np.array([(1, 1), (2, 1), (2, 2), (1, 2)], float)
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert polygons.overlap([square, hole], (0, 0, 4, 4)) == 15.0
    assert polygons.rasterised([square, hole], 4, 4).sum() == 15
    assert polygons.centroid(square) == (2.0, 2.0)


@pytest.mark.parametrize("wanted,level,rescale,size", [(0.25, 0, False, 512), (0.5, 0, True, 1024), (0.7, 0, True, 1433), (0.8, 1, False, 512), (9.0, 2, True, 1152), (0.1, 0, True, None)])
def test_levels(spark, wanted, level, rescale, size):
    row = spark.range(1).select(F.array(F.lit(0.25), F.lit(1.0), F.lit(4.0)).alias("s"), F.lit(wanted).alias("w"))
    row = row.withColumn("c", pyramid.chosen_level(F.col("s"), F.col("w")))
    got = row.select("c.level", "c.rescale", pyramid.read_size(F.lit(512), F.col("w"), F.get("s", F.col("c.level")), F.col("c.rescale")).alias("size")).first()
    assert (got["level"], got["rescale"], got["size"]) == (level, rescale, size)


def test_details(spark):
    got = spark.range(1).select(pyramid.details(F.lit(512), F.lit(512), F.lit(2), F.lit(1)).alias("d")).first()["d"]
    assert (got["n"], got["total_i"], got["total_j"], got["target"], got["details"]) == (4, 2, 2, 2, 1)
    assert spark.range(1).select(pyramid.details(F.lit(512), F.lit(512), F.lit(3), F.lit(1)).alias("d")).first()["d"] is None
