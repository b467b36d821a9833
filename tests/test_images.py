"""Pixel functions against numpy, and the sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, columns, images
from tessera.operators import bags, files, graph, moments
from tessera.sources import fake, geojson, pyramid


def test_array_functions_match_numpy(spark):
    a = np.arange(42).reshape(6, 7)
    df = spark.createDataFrame([(a.flatten().tolist(),)], "px array<int>").select(arrays.rows_of(F.col("px"), 7).alias("r"))
    run = lambda f: np.array(df.select(f(F.col("r")).alias("x")).first()["x"])
    assert (run(lambda r: arrays.flipped(r, True)) == a[:, ::-1]).all()
    assert (run(lambda r: arrays.flipped(r, False)) == a[::-1]).all()
    assert (run(arrays.transposed) == a.T).all()
    for k in range(5):
        assert (run(lambda r, k=k: arrays.rotated(r, k)) == np.rot90(a, k)).all()
    assert run(lambda r: arrays.cropped(r, 6, 4)).shape == (6, 4)
    assert (run(lambda r: arrays.cropped(r, 4, 5)) == a[1:5, 1:6]).all()
    assert (run(lambda r: arrays.padded(r, 9, 230)) == np.pad(a, ((0, 3), (0, 2)), constant_values=230)).all()


def test_crop_with_no_difference_on_one_axis():
    assert images.cropped(np.zeros((10, 8, 3), np.uint8), 8, 8).shape == (8, 8, 3)
    assert images.cropped(np.zeros((2, 5, 9, 9, 1), np.uint8), 4, 4).shape == (2, 5, 4, 4, 1)


def test_pixel_functions():
    rng = np.random.default_rng(0)
    im = rng.integers(0, 256, (12, 9, 3), np.uint8)
    assert images.resized(im, 12, 9).tolist() == im.tolist()
    assert set(np.unique(images.resized(np.kron([[0, 7]], np.ones((4, 4)))[:, :, None].astype(np.uint8), 3, 5, nearest=True))) <= {0, 7}
    assert images.affine(im, 1, 0, 0, 0, 0).tolist() == im.tolist()
    assert images.stain_shifted(im, 0.0, 0.0).astype(int).max() <= 255 and np.abs(images.stain_shifted(im, 0, 0).astype(int) - np.maximum(im, 1)).max() <= 1
    assert np.abs(images.hue_saturation(im, 0, 0).astype(int) - im).max() <= 1
    assert images.longest_side(im, 24).shape == (24, 18, 3)
    assert images.sharpened(im, 0.0).tolist() == im.tolist()
    black = np.zeros((2, 2, 3), np.uint8)
    assert (images.replaced_colour(black) == 230).all()
    assert images.preprocessed(np.full((4, 4, 3), 250, np.uint8), 4, tissue=0.1) is None
    assert images.preprocessed(black, 4, blur=1e9) is None and images.preprocessed(None, 4) is None
    assert images.preprocessed(black, 4).shape == (4, 4, 3)
    with pytest.raises(ValueError):
        images.preprocessed(black, 4, mode="other")
    with pytest.raises(ValueError):
        images.augmented(im, rng, split="other")
    a, b = (images.augmented(im, images.generator(1, 2, 3), 16) for _ in range(2))
    assert a.tolist() == b.tolist() and max(a.shape[:2]) == 16
    assert images.augmented(im, rng, 12, split="val", background=None).tolist() == im.tolist()


def test_moments_golden_case(spark):
    px = [(0, 0, v) for v in (0, 255, 0, 255)] + [(1, 0, v) for v in (255,) * 4]
    sums = moments.channel_sums(spark.createDataFrame(px, "image int, channel int, value int"))
    row = sums.first()
    assert (row["s"], row["q"], row["n"]) == (1.5, 1.5, 2)
    out = moments.mean_and_std(sums).first()
    assert out["mean"] == 0.75 and abs(out["std"] - 0.4330127) < 1e-7


def test_label_defaults(spark):
    rows = spark.createDataFrame([(1, None), (None, 4)], "a int, b int").select(columns.rebased_label("a", 1).alias("l"), columns.group_label("b").alias("g")).collect()
    assert [tuple(r) for r in rows] == [(0, -100), (-100, 4)]


def test_declared_columns_are_checked(spark):
    with pytest.raises(ValueError):
        bags.check_columns(spark.range(1), ["vec"])
    with pytest.raises(ValueError):
        bags.select_by_regex(spark.range(1), "^x_")
    assert bags.number_of_groups(spark.range(3), "group").first()["n_groups"] is None


def test_files_and_geojson(spark, tmp_path):
    feature = lambda kind, c, name: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": {"classification": {"name": name}}}
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]
    (tmp_path / "s2.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", square, "tumor"), feature("MultiPolygon", [square, [square[0]]], "tissue"), feature("Point", [3, 5], "cell")]}))
    (tmp_path / "s10.geojson").write_text(json.dumps([feature("Polygon", square, "tumor")]))
    for name in ("s2.ndpi", "s10.ndpi", "s10_mask.ndpi", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = files.list_files(spark, str(tmp_path), "wsi", excludes=["_mask"])
    assert [r["file_key"] for r in found.collect()] == ["s2", "s10"]
    assert files.get_files(spark, str(tmp_path))["pairs"].count() == 2
    with pytest.raises(files.NoSourceFiles):
        files.list_files(spark, str(tmp_path), "wsi", filters=["nothing"])
    with pytest.raises(ValueError):
        files.list_files(spark, str(tmp_path), "other")
    rows = geojson.read_annotations(spark, str(tmp_path / "*.geojson")).collect()
    got = sorted((r["file_key"], r["label"], r["type"], len(r["rings"]), r["x2"]) for r in rows)
    assert got == [("s10", "tumor", "polygon", 2, 4.0), ("s2", "cell", "point", 1, 3.0), ("s2", "tissue", "polygon", 1, 4.0), ("s2", "tissue", "polygon", 2, 4.0), ("s2", "tumor", "polygon", 2, 4.0)]


def test_fake_dataset(spark):
    own = fake.fake_dataset(spark, 50, (3, 2, 2), (1, 2, 2), (1, 4))
    rows = own.collect()
    assert len(rows) == 50 and all(0 <= v < 1 for r in rows for v in r["image"]) and {v for r in rows for v in r["label"]} == {1, 2, 3, 4}
    assert rows == own.repartition(3).orderBy("index").collect()


def test_regions_come_from_the_right_cells(spark):
    level = np.arange(16 * 16, dtype=np.uint8).reshape(16, 16, 1)
    cells = [("s", 0, r, c, images.encoded(level[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8])) for r in range(2) for c in range(2)]
    cells = spark.createDataFrame(cells, f"file_key string, level int, row long, col long, image {images.IMAGE}")
    request = spark.createDataFrame([(1, "s", 8, 8, 6, 4, {"target": 0.25, "context": None}), (2, "s", 0, 0, 4, 4, {"target": 0.25})], "request long, file_key string, x long, y long, width int, height int, spacing map<string,double>")
    slides = spark.createDataFrame([("s", [0.25])], "file_key string, spacings array<double>")
    got = {r["request"]: images.decoded(r["patch"].asDict()) for r in pyramid.read_regions(pyramid.planned(pyramid.per_resolution(request), slides), cells, 8).collect()}
    assert (got[1] == level[6:10, 5:11]).all()
    assert (got[2][2:, 2:] == level[:2, :2]).all() and (got[2][:2] == 230).all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (40, 2)).astype(float)
    src, dst, dist = graph.nearest(points, np.arange(40), 3, None)
    for i in range(40):
        want = sorted((float(np.hypot(*(points[i] - points[j]))), j) for j in range(40) if j != i)[:3]
        assert [(round(d, 9), j) for d, j in zip(dist[src == i], dst[src == i])] == [(round(d, 9), j) for d, j in want]
    assert len(graph.nearest(points[:1], np.arange(1), 3, None)[0]) == 0
    with pytest.raises(ValueError):
        graph.variants(spark, flips=["x"])
