"""File listings: filters by substring, natural order, association of images and annotations by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import natural_key

#: File extensions by kind.
EXTENSIONS = {"wsi": (".ndpi", ".svs", ".tif", ".tiff", ".mrxs", ".png"), "mrwsi": (".ndpi", ".svs", ".tif", ".tiff", ".mrxs", ".png"), "wsa": (".geojson", ".json")}


class NoSourceFiles(ValueError):
    """A folder without a file of the kind asked for."""


def path_predicate(path: Column, filters: Sequence[str] = (), excludes: Sequence[str] = ()) -> Column:
    """No exclude occurs anywhere in the path, and, if there are filters, at least one of them does."""
    kept = reduce(lambda a, e: a & ~F.contains(path, F.lit(e)), excludes, F.lit(True))
    return kept & reduce(lambda a, f: a | F.contains(path, F.lit(f)), filters, F.lit(False)) if filters else kept


def select_paths(df: DataFrame, path: str, filters: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """The distinct paths that pass, with file_key (the name without its extension) and a natural sort key."""
    out = df.select(F.col(path).alias("path")).distinct().where(path_predicate(F.col("path"), filters, excludes))
    return out.withColumn("file_key", F.regexp_replace(F.regexp_extract("path", r"([^/]*)/?$", 1), r"\.[^.]*$", "")).withColumn("sort_key", natural_key("path"))


def list_files(spark: SparkSession, folder: str, kind: str, filters: Sequence[str] = (), excludes: Sequence[str] = (), recursive: bool = False) -> DataFrame:
    """Files of a kind below a folder; content is never read. Raises if there is none."""
    if kind not in EXTENSIONS:
        raise ValueError(f"unknown kind {kind!r}; one of {sorted(EXTENSIONS)}")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    of_kind = reduce(lambda a, b: a | b, [F.lower("path").endswith(e) for e in EXTENSIONS[kind]])
    out = select_paths(listed.where(of_kind), "path", filters, excludes)
    if out.limit(1).count() == 0:
        raise NoSourceFiles(f"no {kind} files in {folder} (filters {list(filters)}, excludes {list(excludes)})")
    return out.orderBy("sort_key", "path")


def associate(images: DataFrame, annotations: DataFrame, key: str = "file_key") -> DataFrame:
    """Pairs by key; several files of a key stay several rows. Catalyst chooses the join by size."""
    return images.join(annotations, key, "inner")


def get_files(spark: SparkSession, folder: str, image_filters: Sequence[str] = (), annotation_filters: Sequence[str] = (), excludes: Sequence[str] = ("mask",), recursive: bool = False) -> dict[str, DataFrame]:
    """The images, the annotations, and the pairs of both."""
    images = list_files(spark, folder, "wsi", image_filters, excludes, recursive)
    annotations = list_files(spark, folder, "wsa", annotation_filters, (), recursive)
    pairs = associate(images.select("file_key", F.col("path").alias("image_path")), annotations.select("file_key", F.col("path").alias("annotation_path")))
    return {"images": images, "annotations": annotations, "pairs": pairs}
