"""Channel means and deviations from partial sums, image by image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def channel_sums(pixels: DataFrame, image: str = "image", channel: str = "channel", value: str = "value", largest: float = 255.0) -> DataFrame:
    """channel, s (sum of the images' means), q (sum of their mean squares), n (images), from one row a pixel and channel.

    Two levels of grouping: images of different sizes count alike.
    """
    x = F.col(value).cast("double") / F.lit(largest)
    means = pixels.groupBy(image, channel).agg(F.avg(x).alias("_m"), F.avg(x * x).alias("_q"))
    return means.groupBy(channel).agg(F.sum("_m").alias("s"), F.sum("_q").alias("q"), F.count("*").alias("n"))


def mean_and_std(sums: DataFrame, channel: str = "channel") -> DataFrame:
    """The population mean and deviation from sums; adds nothing for channels without images."""
    mean = F.col("s") / F.col("n")
    return sums.select(channel, mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
