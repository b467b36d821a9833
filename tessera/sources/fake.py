"""A synthetic data set of images and label masks, generated where it is read."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items of the data set unless told otherwise.
ITEMS = 1_000_000


def fake_dataset(spark: SparkSession, items: int = ITEMS, input_shape: tuple[int, ...] = (3, 512, 512), output_shape: tuple[int, ...] = (1, 512, 512), classes: tuple[int, int] = (0, 1), seed: int = 42) -> DataFrame:
    """index, image (floats in [0, 1)) and label (integers from the first to the last class, both included), flat in row-major order.

    Values follow from seed, item and place alone. Select ``index`` only, and no pixel is made.
    """
    low, high = classes
    if high < low:
        raise ValueError(f"classes {classes}")
    word = lambda salt: lambda i: F.pmod(F.xxhash64(F.lit(seed + salt), F.col("index"), i), F.lit(1 << 30)) / F.lit(float(1 << 30))
    made = lambda n, salt, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: f(word(salt)(i)))
    rows = spark.range(items).withColumnRenamed("id", "index")
    image = made(prod(input_shape), 0, lambda u: u.cast("float"))
    label = made(prod(output_shape), 1, lambda u: (F.floor(u * (high - low + 1)) + low).cast("int"))
    return rows.select("index", image.alias("image"), label.alias("label"))
