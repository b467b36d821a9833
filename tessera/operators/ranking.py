"""Row numbers over a total order, for tables of any size.

A window without a partition, or with one huge partition, sorts in a single task. Beyond ``WINDOW_ROWS`` rows, ranks come from a range
shuffle instead: rows are sorted within range partitions, numbered there, and shifted by the sizes of the partitions before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

#: Rows that one task may sort.
WINDOW_ROWS = 5_000_000
#: monotonically_increasing_id holds the partition above these bits.
LOCAL_BITS = 33


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """Adds ``name``, the row's place from 0 in a total order."""
    if df.count() <= WINDOW_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    placed = cut_lineage(df.sparkSession, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = placed.withColumn("_part", F.shiftright("_at", LOCAL_BITS))
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.col("_at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return part.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + local).drop("_part", "_before", "_at")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Adds ``name``, the row's place from 0 among those with its keys; a key may hold most of the rows."""
    if df.count() <= WINDOW_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    placed = cut_lineage(df.sparkSession, global_rank(df, [*keys, *order], "_global"))
    first = placed.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min("_global").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return placed.join(first, same).select(*df.columns, (F.col("_global") - F.col("_first")).alias(name))
