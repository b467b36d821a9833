"""Samplers as tables: the order a sampler yields is a column, so results depend on seed, epoch and rows only, not on partitions or retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import global_rank, rank_within
from tessera.session import seeded_key


def weak_shuffle(indices: DataFrame, block: int, seed: int = 42, epoch: int | None = None) -> DataFrame:
    """Adds pos to a table of indices 0..n-1: full blocks in random order, order kept inside a block, the partial last block at the end.

    Only the small table of blocks is ordered.
    """
    n = indices.count()
    seed = seed if epoch is None else seed + epoch
    blocks = indices.sparkSession.range(n // block).select(F.col("id").alias("_block"))
    order = global_rank(blocks, [seeded_key(seed, "_block"), F.col("_block")], "_place")
    at = indices.withColumn("_block", F.expr(f"index div {block}"))
    placed = at.join(order, "_block", "left")
    pos = F.when(F.col("_place").isNull(), F.col("index")).otherwise(F.col("_place") * block + F.col("index") % block)
    return placed.withColumn("pos", pos.cast("long")).drop("_block", "_place")


def batches(ordered: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """Adds batch_id by pos; with ``drop_last`` the partial last batch goes."""
    out = ordered.withColumn("batch_id", F.expr(f"pos div {size}"))
    return out.where(F.col("batch_id") < ordered.count() // size) if drop_last else out


def rank_slices(batched: DataFrame, replicas: int, drop_last: bool = False) -> DataFrame:
    """Deals every batch to ranks in contiguous slices: batch_id, rank, slot, index.

    Batches are padded from their head, as often as it takes, or cut, to a multiple of ``replicas``.
    """
    if replicas < 1:
        raise ValueError(f"{replicas} replicas")
    sizes = batched.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    uneven = F.col("n") % replicas != 0
    cut = F.greatest(F.ceil((F.col("n") - replicas) / F.lit(replicas)), F.lit(0))
    share = F.when(uneven & F.lit(drop_last), cut).otherwise(F.ceil(F.col("n") / F.lit(replicas))).cast("long")
    places = sizes.withColumn("share", share).where("share > 0").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share") * replicas - 1)))
    wanted = places.select("batch_id", F.expr("q div share").alias("rank"), F.expr("q % share").alias("slot"), (F.col("first") + F.col("q") % F.col("n")).alias("pos"))
    return wanted.join(batched.select("batch_id", "pos", "index"), ["batch_id", "pos"]).select("batch_id", "rank", "slot", "index")


def fast_loader(indices: DataFrame, batch: int = 32, replicas: int = 1, drop_last: bool = False, seed: int = 42, epoch: int | None = None) -> DataFrame:
    """Weak shuffling, batches of batch * replicas, contiguous slices by rank."""
    return rank_slices(batches(weak_shuffle(indices, batch, seed, epoch), batch * replicas, drop_last), replicas, drop_last)


def uniform(seed: int, *cols: Column | str) -> Column:
    """A number in (0, 1) from the first 32 bits of the seeded key."""
    return (F.conv(F.substring(seeded_key(seed, *cols), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def weighted_with_replacement(rows: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """As many draws as rows, weight one over the label's count: draw, and the drawn row's key and label.

    Every label has total weight one, so a draw takes a label uniformly and then a row of it: one equi-join, no scan of running sums.
    """
    ranked = rank_within(rows.select(key, label), [label], [F.col(key)], "_rank")
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    numbered = global_rank(counts, [F.col(label)], "_class")
    classes = counts.count()
    draws = rows.sparkSession.range(rows.count()).select(F.col("id").alias("draw"))
    chosen = draws.withColumn("_class", F.floor(uniform(seed, "draw") * classes).cast("long")).withColumn("_u", uniform(seed + 1, "draw"))
    picked = chosen.join(F.broadcast(numbered) if classes <= 100_000 else numbered, "_class").withColumn("_rank", F.floor(F.col("_u") * F.col("_n")).cast("long"))
    return picked.join(ranked, [label, "_rank"]).select("draw", key, label)


def weighted_without_replacement(rows: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """All rows in the order of a weighted draw without replacement: keys -ln(u) / weight, ascending."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    keyed = rows.select(key, label).join(counts, label).withColumn("_key", -F.log(uniform(seed, key)) * F.col("_n"))
    return global_rank(keyed, [F.col("_key"), F.col(key)], "draw").select("draw", key, label)


def one_time_random(rows: DataFrame, key: str, label: str, seed: int = 123) -> DataFrame:
    """Adds rank: the order in which a label's rows are drawn, each once."""
    return rank_within(rows, [label], [seeded_key(seed, key), F.col(key)], "rank")


def one_time_ordered(rows: DataFrame, key: str, label: str) -> DataFrame:
    return rank_within(rows, [label], [F.col(key)], "rank")


def ordered_labels(rows: DataFrame, label: str) -> DataFrame:
    """pos, label, rank: every label as often as it has rows, label after label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    numbered = global_rank(counts, [F.col(label)], "_place")
    above = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # one row a label
    before = numbered.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    out = before.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return out.select((F.col("_before") + F.col("rank")).alias("pos"), label, "rank")


def one_time_batches(rows: DataFrame, key: str, label: str, size: int, seed: int | None = 123) -> DataFrame:
    """batch_id, pos, label and the drawn row's key: ordered labels joined with the label's random (or ordered, without a seed) draws."""
    drawn = one_time_ordered(rows, key, label) if seed is None else one_time_random(rows, key, label, seed)
    found = ordered_labels(rows, label).join(drawn.select(label, "rank", key), [label, "rank"])
    return found.select(F.expr(f"pos div {size}").alias("batch_id"), "pos", label, key)


def collated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a batch, with the named columns as arrays in the order of pos; a batch is as large as its sampler made it."""
    items = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    grouped = rows.groupBy("batch_id").agg(items.alias("_items"))
    field = lambda c: F.transform("_items", lambda s: s[c])
    return grouped.select("batch_id", *[field(c).alias(c) for c in columns])
