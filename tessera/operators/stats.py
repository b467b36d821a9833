"""Counts and areas of annotations by label, file and both, with zeros where nothing is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(annotations: DataFrame, value: Column, name: str) -> DataFrame:
    return annotations.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name))


def per(annotations: DataFrame, keys: list[str], dimension: DataFrame, value: Column, name: str) -> DataFrame:
    """sum(value) for every row of ``dimension`` (the keys); keys outside it are ignored, missing ones get zero.

    Partial sums are made before the shuffle, so a frequent key costs no more than a rare one.
    """
    sums = annotations.groupBy(*keys).agg(F.sum(value).alias(name))
    return dimension.select(*keys).distinct().join(sums, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def grid(labels: DataFrame, files: DataFrame) -> DataFrame:
    """Every label with every file: the product of two dimensions, which is the result itself; Spark broadcasts the smaller one if it is small."""
    return files.distinct().crossJoin(labels.distinct())


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds n_label and weight, one over the number of rows of the label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_label"))
    return rows.join(counts, label).withColumn("weight", F.lit(1.0) / F.col("n_label"))


def label_distribution(rows: DataFrame, *labels: str) -> DataFrame:
    """Counts of the (joint) values of labels."""
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))
