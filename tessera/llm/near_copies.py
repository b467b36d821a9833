"""Near copies: all pairs of texts whose sets of 5-word shingles have an exact Jaccard similarity of 0.8 or more, and their groups.

Texts with the same set are one node under a hash of the set. Candidates come from two routes. The vantage-point tree of
``vp_simhash`` links fingerprints of the sets at 2 differing bits or fewer; this only joins large groups early. Completeness comes from prefixes:
under any common order of shingles, two sets of similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each. So every
list of texts that share a prefix shingle is searched; shingles that the very same texts share are searched once. A few lists of each text, chosen by hash, are searched
from one text each, which closes most groups at a few rows a text; then only lists with texts of several groups are left. Large lists are searched from ``CENTRES`` first, the texts that share the most with others (the original
of its edited copies, if it is there), then from the best ones that this didn't reach; then all pairs of a list that are not in one group yet, less those whose
lengths and shared prefix rule the similarity out. Every link is verified on the whole sets, but for pairs that 1024 parities of the sets rule out (where sets are too large to be sent whole, they would go with every pair). The order puts shingles that are frequent in a hash sample last; order and centres set the
cost and never the result.

Nulls: a null text is empty, and empty texts are copies of each other. Texts of fewer than 5 words are one shingle. Repeated rows and null ids are nodes by their sets like any other. An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common, vp_simhash
from tessera.llm.components import components
from tessera.llm.suffix_tree_lm import bit_set

WIDTH = 5
#: Sets sampled for the order of shingles, occurrences there that make a shingle frequent, and how many are broadcast at most.
SAMPLE, OFTEN, MOST = 20_000, 2, 500_000
#: Texts whose ids are sent whole instead of shuffling all texts, and bytes of sets that are sent whole instead of going with every pair.
FEW, SMALL_SETS = 500_000, 8 << 20
#: Links whose groups are found in one task.
ALONE = 1_000_000
#: Lists above this size are searched from so many centres first, in at most that many rounds.
LARGE, CENTRES, ROUNDS = 16, 16, 2
#: Before that, so many lists of each text are searched from one centre, in so many rounds.
PICKED, QUICK_ROUNDS = 4, 1
#: Bits of the parities that rule most pairs out before whole sets go with them.
PARITIES = 1024
FACTORS = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def shingles(raw: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8."""
    words = raw.lower().split()  # as in vp_simhash
    w = np.array([xxhash.xxh64_intdigest(x, 42) for x in words], np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - WIDTH + 1)
    h = np.full(n, min(len(w), WIDTH), np.uint64)
    for i in range(min(len(w), WIDTH)):
        h += w[i : i + n] * FACTORS[i]
    h ^= h >> np.uint64(31)
    h *= FACTORS[0]
    return np.unique(h ^ (h >> np.uint64(29)))


def key_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def parities_of(own: np.ndarray) -> np.ndarray:
    """How many shingles fall on each of PARITIES bits, modulo 2; those of two sets differ in no more bits than the sets differ in shingles."""
    return np.packbits((np.bincount((own & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8), bitorder="little").view("<i8")


def fingerprint_of(own: np.ndarray) -> int:
    if not len(own):
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(own), 65_536):
        bits += np.unpackbits(own[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(own), bitorder="little").view("<u8")[0])


def prefix_size(n: int) -> int:
    """Shingles of a set of n of which a set of similarity 0.8 or more shares at least one, whatever the order."""
    return n - -(-4 * n // 5) + 1 if n else 0


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles that are frequent in a sample of texts, the most frequent last."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in common.bytes_of(batch.column(2))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64), pa.int64())], names=["s"])

    some = common.hash_sample(_texts(docs), n, SAMPLE, "doc_id", "th")
    top = common.map_batches(some, run, "s long").groupBy("s").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(MOST).toArrow()
    return top.column(0).to_numpy().view(np.uint64)[::-1]


def nodes(spark: SparkSession, docs: DataFrame, late: np.ndarray) -> DataFrame:
    """doc_id, th (a hash that tells texts apart under one id), key and fp of every row, n (shingles) and the prefix of its set; ``late`` stands last in the order."""
    order = np.argsort(late, kind="stable")
    shared = spark.sparkContext.broadcast((late[order], order.astype(np.int64)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, rank = shared.value
        key, fp, n, prefix = [], [], [], []
        for raw in common.bytes_of(batch.column(2)):
            own = shingles(raw)
            key.append(key_of(own))
            fp.append(fingerprint_of(own))
            n.append(len(own))
            if len(known) and len(own):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                own = own[np.argsort(np.where(known[at] == own, rank[at] + 1, 0), kind="stable")]
            prefix.append(own[: prefix_size(n[-1])].view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _longs(key), _longs(fp), pa.array(n, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "th", "key", "fp", "n", "prefix"])

    return common.map_batches(_texts(docs), run, "doc_id long, th long, key long, fp long, n int, prefix array<long>")


def _small(table: DataFrame) -> DataFrame:
    """The table, to be sent whole if it has at most FEW rows."""
    return F.broadcast(table) if table.count() <= FEW else table


def sets_of(docs: DataFrame, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, the whole set (own) and its parities of the keys wanted, each from one text that has it."""
    first = rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("th").isNull().alias("none"), "th")).alias("f"))
    first = _small(common.cut_lineage(docs.sparkSession, first.select(F.col("f.doc_id").alias("_id"), F.col("f.th").alias("_th"))))
    texts = _texts(docs).join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("th").eqNullSafe(F.col("_th")), "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in common.bytes_of(batch.column(2))]
        return pa.RecordBatch.from_arrays([_longs([key_of(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parities_of(s) for s in sets], pa.list_(pa.int64()))], names=["key", "own", "parities"])

    return common.map_batches(texts, run, "key long, own array<long>, parities array<long>").dropDuplicates(["key"])


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sets' parities do not rule out: at a similarity of 0.8, sets differ in a ninth of their shingles together at most."""
    few = sets.select("key", F.size("own").alias("n"), "parities")
    left, right = few.select(F.col("key").alias("a"), "n", F.col("parities").alias("x")), few.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("parities").alias("y"))
    differ = reduce(Column.__add__, [F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(PARITIES // 64)])
    return pairs.join(left, "a").join(right, "b").where(9 * differ <= F.col("n") + F.col("m")).select("a", "b")


def verified(spark: SparkSession, docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets have a Jaccard similarity of 0.8 or more."""
    pairs = common.cut_lineage(spark, pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = kept = common.written(spark, sets_of(docs, rows.select("doc_id", "th", "key"), keys), "shingle-sets")
    if (sets.agg(F.sum(F.size("own"))).first()[0] or 0) * 8 <= SMALL_SETS:
        sets = F.broadcast(sets)
    else:
        pairs = common.cut_lineage(spark, possible(pairs, sets))
    left, right = sets.select(F.col("key").alias("a"), F.col("own").alias("x")), sets.select(F.col("key").alias("b"), F.col("own").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    out = common.cut_lineage(spark, pairs.join(left, "a").join(right, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))
    common.drop_written(spark, kept)
    common.release(spark)
    return out


def postings(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """s, key, n, many (keys in the list) and times of the prefix shingles that several keys share; shingles that the very same keys share are one list, ``times`` of them."""
    own = rows.select("key", "n", "prefix").dropDuplicates(["key"])
    many = own.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("many")).where("many > 1")
    many = common.written(spark, many, "shared-shingles")
    common.release(spark)
    shared = spark.sparkContext.broadcast(bit_set(many.select(F.col("s").alias("key")), many.count()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prefix = batch.column(2)
        flat, offsets = prefix.values.to_numpy(zero_copy_only=False), prefix.offsets.to_numpy()
        flat = flat[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        at = np.flatnonzero(shared.value.has(flat.astype(np.int64).view(np.uint64)))
        row = np.repeat(np.arange(len(sizes)), sizes)
        key, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(flat[at], pa.int64()), pa.array(key[row[at]], pa.int64()), pa.array(n[row[at]], pa.int32())], names=["s", "key", "n"])

    live = common.map_batches(own, run, "s long, key long, n int")  # but for few, those in the table
    lists = common.written(spark, live.join(many, "s"), "lists")
    common.drop_written(spark, many)
    common.release(spark)
    members = [F.bit_xor(F.xxhash64("key", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]  # equal if the keys are, by 128 bits of hashes
    alike = lists.groupBy("s", "many").agg(*members).groupBy("many", "x1", "x2").agg(F.min("s").alias("s"), F.count("*").alias("times"))
    out = common.written(spark, lists.join(alike.select("s", "times"), "s"), "classes")
    common.drop_written(spark, lists)
    common.release(spark)
    return out


def contested(named: DataFrame) -> DataFrame:
    """The lists that hold texts of several groups; ``own`` is how many of a text's prefix shingles they stand for, so no text of another group shares more."""
    of_list = Window.partitionBy("s")
    several = named.drop("own").withColumn("_lo", F.min("root").over(of_list)).withColumn("_hi", F.max("root").over(of_list)).where("_lo <> _hi").drop("_lo", "_hi")
    return several.withColumn("own", F.sum("times").over(Window.partitionBy("key")))


def groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, th, key and component (the smallest key of the group) of every row."""
    common.prepare(spark)
    rows = common.written(spark, nodes(spark, docs, frequent(docs, docs.count())), "nodes")
    live = postings(spark, rows)  # the complete route: lists of the keys that share a prefix shingle
    weight = common.cut_lineage(spark, live.groupBy("key").agg(F.sum(F.col("many") * F.col("times")).alias("weight")))  # how much a text shares with others
    live = live.drop("many").join(weight, "key")
    # the tree's route: sets of one fingerprint, and of linked fingerprints
    reps = common.cut_lineage(spark, rows.groupBy("fp").agg(F.min("key").alias("rep")))
    tree = vp_simhash.link(spark, reps.select("fp"))
    near = rows.join(reps, "fp").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    near = near.unionByName(tree.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("_a")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    # two prefixes share no more than either shares with any; shared shingles that are not in both prefixes lie behind the one that ends first
    behind = lambda n: F.ceil(4 * F.col(n) / 5) - 1
    enough = lambda c: 9 * (c + F.greatest(behind("n"), behind("m"))) >= 4 * (F.col("n") + F.col("m"))
    size = (F.least("n", "m") * 5 >= F.greatest("n", "m") * 4) & enough(F.least("own", "owns"))
    links = verified(spark, docs, rows, near)
    common.release(spark)
    named = common.cut_lineage(spark, contested(_named(spark, live, links)))
    for k in range(QUICK_ROUNDS):
        # near copies agree on most of the lists that a hash picks: most groups close by a few rows a text, instead of a row for each list that two texts share
        picked = named.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("s", F.lit(k)), "s"))).where(F.col("_k") <= PICKED)
        centre = F.max(F.struct("weight", F.col("key").alias("b"), F.col("n").alias("m"), F.col("own").alias("owns"), F.col("root").alias("centre"))).alias("c")
        centres = picked.groupBy("s").agg(centre).select("s", "c.b", "c.m", "c.owns", "c.centre")
        pairs = picked.join(centres, "s").where((F.col("root") != F.col("centre")) & size).select(F.col("key").alias("a"), "b")
        links = links.unionByName(verified(spark, docs, rows, pairs))
        named = common.cut_lineage(spark, contested(_named(spark, named, links)))
    tried = None
    for _ in range(ROUNDS):
        # the best texts of every large list, but for those in a group that was searched from in this list before
        left = named if tried is None else named.join(tried, ["s", "root"], "left_anti")
        best = left.withColumn("_k", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("weight"), "key"))).where(F.col("_k") <= CENTRES)
        large = named.groupBy("s").agg(F.count("*").alias("many"), F.countDistinct("root").alias("roots")).where((F.col("many") > LARGE) & (F.col("roots") > 1))
        centres = common.cut_lineage(spark, large.join(best.drop("many", "roots"), "s").select("s", F.col("key").alias("b"), F.col("n").alias("m"), F.col("own").alias("owns"), F.col("root").alias("centre")))
        if not centres.limit(1).count():
            break
        pairs = named.join(centres, "s").where((F.col("root") != F.col("centre")) & size).select(F.col("key").alias("a"), "b")
        more = verified(spark, docs, rows, pairs)
        links = links.unionByName(more)
        named = common.cut_lineage(spark, contested(_named(spark, named, links)))
        now = centres.join(named.select("s", F.col("key").alias("b"), "root"), ["s", "b"]).select("s", "root").distinct()
        tried = now if tried is None else tried.unionByName(now)
    other = named.select("s", F.col("key").alias("b"), F.col("n").alias("m"), F.col("own").alias("owns"), F.col("root").alias("other"))
    found = named.join(other, "s").where((F.col("key") < F.col("b")) & (F.col("root") != F.col("other")) & size)
    found = found.groupBy(F.col("key").alias("a"), "b", "n", "m").agg(F.sum("times").alias("c"))
    found = found.where(enough(F.col("c")))
    links = links.unionByName(verified(spark, docs, rows, found.select("a", "b")))
    roots = components(spark, links, ALONE).select(F.col("node").alias("key"), "root")
    out = common.cut_lineage(spark, rows.select("doc_id", "th", "key").join(roots, "key", "left").select("doc_id", "th", "key", F.coalesce("root", "key").alias("component")))
    common.drop_written(spark, rows)
    common.release(spark)
    return out


def _named(spark: SparkSession, live: DataFrame, links: DataFrame) -> DataFrame:
    """The lists with the group that each text is in so far; groups only grow, so lists of one group need not come back."""
    roots = components(spark, links, ALONE).select(F.col("node").alias("key"), "root")
    return live.drop("root").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
