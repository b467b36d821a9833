"""Feature bags: instances of slides with labels, coordinates and survival columns that may be absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import MISSING_COORDINATE, coordinates, group_label, rebased_label


def check_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Raises if a named column is missing: schemas are declared, not guessed from the number of keys."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def slide_index(slides: DataFrame, name: str = "slide_name") -> DataFrame:
    """The slides in the order of their names, numbered from 0 in ``index``."""
    from tessera.operators.ranking import global_rank

    return global_rank(slides, [F.col(name)], "index")


def read_bags(slides: DataFrame, instances: DataFrame, resolutions: Sequence[str] = ("features_target",), base_label: int = 0, survival: bool = False) -> DataFrame:
    """One row an instance: slide_name, resolution, instance, vec, labels, labels_group, coords and, if asked for, survtime and event.

    Instances are pruned to the resolutions before the join. The target resolution is called ``features``. Absent labels are -100 and are not rebased.
    """
    check_columns(instances, ["slide_name", "resolution", "instance", "vec"])
    check_columns(slides, ["slide_name", *(["survtime", "event"] if survival else [])])
    for c in ("labels", "labels_group"):
        if c not in slides.columns:
            slides = slides.withColumn(c, F.lit(None).cast("int"))
    for c in ("coords_x", "coords_y"):
        if c not in instances.columns:
            instances = instances.withColumn(c, F.lit(None).cast("float"))
    wanted = instances.where(F.col("resolution").isin(*resolutions))
    facts = slides.select("slide_name", rebased_label("labels", base_label).alias("labels"), group_label("labels_group").alias("labels_group"), *([F.col("survtime").cast("double"), F.col("event").cast("short")] if survival else []))
    out = wanted.join(facts, "slide_name")
    named = F.when(F.col("resolution") == "features_target", F.lit("features")).otherwise(F.col("resolution"))
    return out.select("slide_name", named.alias("resolution"), "instance", "vec", "labels", "labels_group", coordinates("coords_x", "coords_y").alias("coords"), *(["survtime", "event"] if survival else []))


def with_default_point(instances: DataFrame) -> DataFrame:
    """Bags without any coordinate hold a single point (-1, -1): slide_name, coords."""
    point = F.struct(F.col("coords_x").cast("float").alias("x"), F.col("coords_y").cast("float").alias("y"))
    known = instances.where(F.col("coords_x").isNotNull() & F.col("coords_y").isNotNull()).select("slide_name", point.alias("coords"))
    none = instances.select("slide_name").distinct().join(known.select("slide_name").distinct(), "slide_name", "left_anti")
    missing = F.struct(F.lit(MISSING_COORDINATE).cast("float").alias("x"), F.lit(MISSING_COORDINATE).cast("float").alias("y"))
    return known.unionByName(none.select("slide_name", missing.alias("coords")))


def by_name(bags: DataFrame, name: str) -> DataFrame:
    return bags.where(F.col("slide_name") == name)


def by_index(rows: DataFrame, i: int) -> DataFrame:
    return rows.where(F.col("index") == i)


def bag_shape(instances: DataFrame) -> DataFrame:
    """n_slides, n_instances and the smallest and largest width of a vector: every row is looked at, not only the first."""
    return instances.agg(F.countDistinct("slide_name").alias("n_slides"), F.count("*").alias("n_instances"), F.min(F.size("vec")).alias("min_width"), F.max(F.size("vec")).alias("max_width"))


def number_of_groups(slides: DataFrame, group: str) -> DataFrame:
    """The number of distinct groups; null where the slides have no such column."""
    if group not in slides.columns:
        return slides.sparkSession.createDataFrame([(None,)], "n_groups long")
    return slides.agg(F.countDistinct(group).alias("n_groups"))


def labelled_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Every image with the label of its index, or with the first label if there is none for it: index, images, label."""
    first = labels.where("index = 0").select(F.col("label").alias("_first"))
    joined = images.join(labels, "index", "left").join(F.broadcast(first.limit(1)), how="left")
    return joined.withColumn("label", F.coalesce("label", "_first")).drop("_first")


def select_by_regex(df: DataFrame, regex: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns whose names match from their start, and those to keep; others are never read."""
    import re

    found = [c for c in df.columns if re.match(regex, c)]
    if not found:
        raise ValueError(f"no column matches {regex!r} in {df.columns}")
    return df.select(*keep, *found)


def long_form(df: DataFrame, index: str, resolutions: dict[str, str]) -> DataFrame:
    """One row an item and resolution: index, resolution, images, from one column a resolution."""
    pairs = [F.struct(F.lit(k).alias("resolution"), F.col(c).alias("images")) for k, c in resolutions.items()]
    return df.select(index, F.explode(F.array(*pairs)).alias("_p")).select(index, "_p.resolution", "_p.images")
