"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else. Windows of LENGTH bytes can only be equal if their least
hash over ``GRAM`` bytes is equal and stands at the same place in them; so every text is cut into runs of window starts with one such anchor, about
one run for 77 bytes. The runs of a batch of texts, sorted by anchor, are its sparse suffix array: all suffixes that can begin a long match stand in it.

The index is a family of such arrays (``Family``). A new batch is merge-scanned with itself and with the array of every level; runs whose anchor occurs again, of the batch or of a
level, come out. Then the batch becomes a level, and levels of equal size merge, so that sizes grow geometrically and n batches leave log n levels. Levels are tables in the shared
folder and stay, so texts that come later are added to them. A table that is given at once is dealt into ``BATCHES`` by hash.

The runs that came out are compared by their bytes, in rounds. In each, equal runs of one key (the anchor at first) repeat each other as a whole, however many there are, and one of each
kind goes on; kinds that are alone under their key leave. Keys with at most ``GROUP`` kinds are settled by a suffix array of their windows in one task. Beyond that the key is too short: the runs are
split at fixed places relative to the anchor, which makes all windows of a half share more bytes, and these are the longer key of the next round. After eight halvings a key is a whole window, so no
group stays large, and no task holds more than GROUP runs of a key.

All counts cover all texts. Keys and kinds are hashes of 64 bits each, so that 128 bits decide that runs are equal; windows in a task are compared by their bytes.

Nulls: a null text is empty; rows with a null id take part like any other. Repeated rows (one id and one text) are one text with a multiplicity: all its windows repeat. Very long texts
are indexed whole. No result hangs on ties. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

LENGTH, GRAM = 200, 48
#: Batches that a table given at once is dealt into.
BATCHES = 4
#: Kinds under one key that are compared in one task; beyond, the key becomes longer.
GROUP = 512
#: Windows that are handled at once in a long text: positions take 20 bits.
PIECE = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15


def byte_weights() -> np.ndarray:
    """256 fixed pseudo-random odd weights of 64 bits."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


WEIGHTS = byte_weights()


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A polynomial hash of every string of ``gram`` bytes, by doubling, then mixed."""
    weight = lambda n: np.uint64(pow(MULTIPLIER, n, 1 << 64))
    made = {1: WEIGHTS[b]}
    size = 1
    while 2 * size <= gram:
        made[2 * size] = made[size][:-size] * weight(size) + made[size][size:]
        size *= 2
    h, have = made[size], size
    while have < gram:
        while have + size > gram:
            size //= 2
        n = len(b) - have - size + 1
        h = h[:n] * weight(size) + made[size][have : have + n]
        have += size
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, number of window starts, place of the anchor behind the first start) of every run of a text."""
    out = [], [], [], []
    width, mask = length - gram + 1, np.uint64(0xFFFFF)
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        part = np.frombuffer(raw[at : at + PIECE + length - 1], np.uint8)
        h = gram_hashes(part, gram)
        least, size = (h & ~mask) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * size <= width:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        anchor = (least & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        out[0].append(h[anchor[first]].view(np.int64))
        out[1].append(first + at)
        out[2].append(np.diff(np.append(first, len(anchor))))
        out[3].append(anchor[first] - first)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def equal_windows(strings: list[bytes], length: int = LENGTH) -> list[set[int]]:
    """For every string the starts of windows that other strings hold, too, by a sorted array of all windows."""
    order = sorted((s[at : at + length], i, at) for i, s in enumerate(strings) for at in range(len(s) - length + 1))
    found: list[set[int]] = [set() for _ in strings]
    for (a, i, x), (b, j, y) in zip(order, order[1:]):
        if a == b:
            found[i].add(x)
            found[j].add(y)
    return found


def spans_of(starts: Iterable[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Merged (from, to) of windows at the given starts."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + length))
        else:
            out.append((s, s + length))
    return out


RUNS = "h long, sid long, doc_id long, th long, at int, n int, o int, many long"


def all_runs(rows: DataFrame, length: int) -> DataFrame:
    """h, sid (a hash of the run's bytes), doc_id, th, at, n, o (place of the anchor) and many of every run of ``rows`` (doc_id, th, text, many: equal rows)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        digest = xxhash.xxh3_64_intdigest
        for doc_id, th, raw, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.bytes_of(batch.column(2)), batch.column(3).to_pylist()):
            h, at, n, o = runs(raw, length, min(GRAM, length // 2))
            sid = [digest(raw[a:b]) for a, b in zip(at.tolist(), (at + n + (length - 1)).tolist())]
            cols[0].append(h)
            cols[1].append(np.array(sid, np.uint64).view(np.int64))
            cols[2] += [doc_id] * len(h)
            cols[3] += [th] * len(h)
            for c, x in zip(cols[4:7], (at, n, o)):
                c.append(x)
            cols[7].append(np.full(len(h), many, np.int64))
        flat = {k: np.concatenate(cols[k]) if cols[k] else np.zeros(0, np.int64) for k in (0, 1, 4, 5, 6, 7)}
        return pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), *(pa.array(flat[k].astype(np.int32)) for k in (4, 5, 6)), pa.array(flat[7])], names=[x.split()[0] for x in RUNS.split(", ")])

    return common.map_batches(rows, run, RUNS)


class Family:
    """The logarithmic index family: written tables of runs, sorted by anchor, of geometrically growing size."""

    def __init__(self, spark: SparkSession, length: int = LENGTH):
        self.spark, self.length = spark, length
        self.levels: list[tuple[int, DataFrame]] = []  # batches in it, runs; the largest first

    def _written(self, found: DataFrame) -> DataFrame:
        out = common.written(self.spark, found.repartition("h").sortWithinPartitions("h"), "level")
        common.release(self.spark)
        return out

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, th, text, many) and returns the runs, of the batch and of all levels, whose anchor meets another by that."""
        new = self._written(all_runs(rows, self.length))
        anchors = new.groupBy("h").agg((F.sum("many") > 1).alias("again"))
        out = []
        for _, level in self.levels:
            met = level.join(anchors.select("h"), "h", "left_semi")
            out.append(met)
            anchors = anchors.join(met.select("h").distinct().withColumn("met", F.lit(True)), "h", "left").select("h", (F.col("again") | F.coalesce("met", F.lit(False))).alias("again"))
        out.append(new.join(anchors.where("again").select("h"), "h", "left_semi"))
        found = common.written(self.spark, reduce(DataFrame.unionByName, out), "met")
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            merged_level = self._written(level.unionByName(new))
            common.drop_written(self.spark, level)
            common.drop_written(self.spark, new)
            new, size = merged_level, 2 * size
        self.levels.append((size, new))
        common.release(self.spark)
        return found

    def drop(self) -> None:
        for _, level in self.levels:
            common.drop_written(self.spark, level)
        self.levels = []


#: Runs on their way through the rounds: offsets lo <= o < hi are those that windows of the run may have to the anchor.
ROUND = "key long, sid long, doc_id long, th long, at int, o int, lo int, hi int, copies long, bytes binary"


def with_bytes(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs (h, sid, doc_id, th, at, n, o, copies, kinds) with their bytes."""
    by = wanted.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct("h", "sid", "at", "n", "o", "copies", "kinds")).alias("own"))  # no more than the text holds
    joined = rows.join(by, rows["doc_id"].eqNullSafe(by["_d"]) & (rows["th"] == by["_t"])).select("doc_id", "th", "text", "own")
    width = length - min(GRAM, length // 2) + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, th, raw, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.bytes_of(batch.column(2)), batch.column(3).to_pylist()):
            out += [(r["h"], r["sid"], doc_id, th, r["at"], r["o"], 0, width, r["copies"], raw[r["at"] : r["at"] + r["n"] + length - 1], r["kinds"]) for r in own]
        return _round_batch(out, True)

    return common.map_batches(joined, run, ROUND + ", kinds long")


def _round_batch(out: list[tuple], kinds: bool = False) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.int64(), pa.binary()] + [pa.int64()] * kinds
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(types), types)], names=[x.split()[0] for x in (ROUND + ", kinds long" * kinds).split(", ")])


MARKS = "doc_id long, th long, start int, stop int"


def marks_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "th", "start", "stop"])


def settled(texts: DataFrame, length: int) -> DataFrame:
    """Spans of windows that other runs of their key hold, too, for runs without copies: one group after the other, each at most GROUP runs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def matched() -> list[tuple]:
            found = equal_windows([r[5] for r in group], length)
            return [(r[1], r[2], r[3] + a, r[3] + b) for r, starts in zip(group, found) if r[4] == 1 for a, b in spans_of(starts, length)]

        for batch in it:
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if group and group[0][0] != row[0]:
                    out += matched()
                    group = []
                group.append(row)
            yield marks_batch(out)
        if group:
            yield marks_batch(matched())

    return texts.select("key", "doc_id", "th", "at", "copies", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, MARKS)


def halves(texts: DataFrame, length: int) -> DataFrame:
    """Every run split at the middle of its offsets, each part under the hash of the bytes that all windows of its half share."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, _, doc_id, th, at, o, lo, hi, copies, raw in zip(*(batch.column(i).to_pylist() for i in range(10))):
            mid, last = (lo + hi) // 2, o - (len(raw) - length)
            for a, b in ((lo, mid), (mid, hi)):
                top, low = min(o, b - 1), max(last, a)
                if low > top:
                    continue
                part = raw[o - top : o - low + length]
                core = part[top - a : top - b + 1 + length]
                seed = (key ^ (a << 40) ^ (b << 20)) & 0xFFFFFFFFFFFFFFFF
                own = np.array([xxhash.xxh3_64_intdigest(core, seed), xxhash.xxh3_64_intdigest(part)], np.uint64).view(np.int64).tolist()
                out.append((*own, doc_id, th, at + o - top, top, a, b, copies, part))
        return _round_batch(out)

    return common.map_batches(texts.select(*[x.split()[0] for x in ROUND.split(", ")]), run, ROUND)


def next_round(spark: SparkSession, split: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans of runs without copies that equal others, one run of each kind that isn't alone under its key, with kinds)."""
    each = split.groupBy("key", "sid").agg(F.count("*").alias("equal"), F.sum("copies").alias("all_copies"), F.min(F.struct("doc_id", "th", "at")).alias("first"))
    each = common.written(spark, each, "kinds")
    marks = split.join(each.where("equal > 1").select("key", "sid"), ["key", "sid"]).where("copies = 1").select("doc_id", "th", F.col("at").alias("start"), (F.col("at") + F.length("bytes")).alias("stop"))
    kinds = each.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    stands = each.select("key", "sid", "all_copies", "first").join(kinds, "key")
    left = split.join(stands, ["key", "sid"]).where(F.struct("doc_id", "th", "at").eqNullSafe(F.col("first")))
    return marks, left.withColumn("copies", F.col("all_copies")).select(*[x.split()[0] for x in ROUND.split(", ")], "kinds")


def repeated_runs(spark: SparkSession, kept: DataFrame) -> DataFrame:
    """Runs whose anchor occurs again: their columns, copies (equal runs), kinds (different runs of the anchor) and whether a run stands for its kind."""
    # each step is written before the next joins it, so that every join is of plain tables and a hot anchor's rows can be split
    each = kept.groupBy("h", "sid").agg(F.sum("many").alias("copies"), F.min(F.struct("doc_id", "th", "at")).alias("first"))
    each = common.written(spark, each, "kinds")
    kinds = common.written(spark, each.join(each.groupBy("h").agg(F.count("*").alias("kinds")), "h").where("copies > 1 or kinds > 1"), "kinds-of-anchors")
    common.drop_written(spark, each)
    stands = F.struct("doc_id", "th", "at").eqNullSafe(F.col("first"))
    out = common.written(spark, kept.join(kinds, ["h", "sid"]).select("h", "sid", "doc_id", "th", "at", "n", "o", "copies", "kinds", stands.alias("stands")), "runs")
    common.drop_written(spark, kinds)
    return out


def met_runs(spark: SparkSession, rows: DataFrame, length: int, batches: int) -> DataFrame:
    """The runs of ``rows`` (doc_id, th, text, many) whose anchor occurs again, from a family that is fed batch by batch."""
    family, met = Family(spark, length), []
    batch = F.pmod(F.xxhash64("doc_id", "th"), F.lit(batches))
    for i in range(batches):
        met.append(family.add(rows.where(batch == i) if batches > 1 else rows))
    found = reduce(DataFrame.unionByName, met)
    out = common.written(spark, found.dropDuplicates(["doc_id", "th", "at"]) if batches > 1 else found, "met-runs")
    family.drop()
    for m in met:
        common.drop_written(spark, m)
    common.release(spark)
    return out


def repeated_spans(spark: SparkSession, rows: DataFrame, length: int = LENGTH, group: int | None = None, batches: int | None = None) -> DataFrame:
    """doc_id, th and spans (array of struct start, stop; not merged) of the texts in ``rows`` (doc_id, th, text, many; distinct by id and th) that repeat something."""
    group, made = group or GROUP, []
    kept = met_runs(spark, rows, length, batches or BATCHES)
    judged = repeated_runs(spark, kept)
    common.drop_written(spark, kept)
    common.release(spark)
    texts = common.written(spark, with_bytes(rows, judged.where("stands and kinds > 1"), length), "run-bytes")
    common.release(spark)
    marks = judged.where("copies > 1").select("doc_id", "th", F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("stop"))
    while True:
        made.append(texts)
        marks = marks.unionByName(settled(texts.where(F.col("kinds") <= group), length))
        if not texts.where(F.col("kinds") > group).limit(1).count():
            break
        split = common.written(spark, halves(texts.where(F.col("kinds") > group), length), "split-runs")
        equal, left = next_round(spark, split, length)
        marks = marks.unionByName(equal)
        texts = common.written(spark, left, "run-bytes")
        made.append(split)
    spans = common.written(spark, marks.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    for t in (*made, judged):
        common.drop_written(spark, t)
    common.release(spark)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def deduplicated(spark: SparkSession, docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """All columns of ``docs``, and n_bytes, removed (array of struct start, stop: maximal byte spans) and kept.

    ``kept`` holds the remaining bytes, or as text what of them is whole characters. Columns of ``docs`` with these names are replaced.
    """
    common.prepare(spark)
    docs = docs.drop("n_bytes", "removed", "kept").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    again = common.repeated_ids(docs)
    mark = F.xxhash64("text") if again else F.lit(0).cast("long")
    rows = docs.select("doc_id", mark.alias("th"), "text")
    if again:  # equal rows are one text
        rows = common.written(spark, rows.groupBy("doc_id", "th").agg(F.min("text").alias("text"), F.count("*").alias("many")), "distinct-rows")
    else:
        rows = rows.withColumn("many", F.lit(1).cast("long"))
    spans = repeated_spans(spark, rows, length)
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("spans").alias("_spans"))
    joined = docs.withColumn("_th", mark).join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left").drop("_th", "_t", "_d")
    names = [c for c in joined.columns if c != "_spans"]
    text = names.index("text")
    span = "array<struct<start:int,stop:int>>"
    schema = joined.select(*names, F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast(span).alias("removed"), F.lit("" if as_text else b"").alias("kept")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, own = common.bytes_of(batch.column(text)), [merged(s) for s in batch.column(len(names)).to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        added = [pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in own], kind), pa.array([cut(t, s).decode("utf-8", "ignore") if as_text else cut(t, s) for t, s in zip(texts, own)], pa.string() if as_text else pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*names, "n_bytes", "removed", "kept"])

    return common.map_batches(joined.select(*names, "_spans"), run, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(spark, common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
