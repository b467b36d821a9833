"""Byte-level BPE that encodes content-defined chunks once and repairs their joins.

A rolling polynomial hash over 32 bytes cuts texts where its top bits are zero, so copies and shared passages fall into equal
chunks wherever they stand. Chunks that occur more than once over the whole table are ranked by what they save (occurrences beyond the first, times length);
the best of them, up to ``DICTIONARY_BYTES`` and ``DICTIONARY_CHUNKS``, form a dictionary that is encoded once for all tasks and broadcast. Its bound doesn't hang on the corpus, and it is filled
however many chunks are of like worth. Every other chunk is encoded once a task, as far as the task's bounded
cache holds it, the chunk unused for longest leaving first. Which chunk is reused never changes a result: at each join the pre-tokens that the cut could have
changed are split again on the whole text, until a boundary of the new split meets a boundary of the next chunk's
own split; from there on both agree, as the splitting pattern looks forward only.

Nulls: a null text is empty and has no ids; a null id is kept. Repeated rows are kept. Ties of worth are filled by the chunk's hash. Very long texts are cut and encoded whole.
An empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, pretokens

WINDOW, MEAN_BITS, LEAST, MOST = 32, 11, 256, 65_536
#: Bounds of the broadcast dictionary, and the chunks a task remembers besides.
DICTIONARY_CHUNKS, DICTIONARY_BYTES, CACHE_CHUNKS = 4_096, 4 << 20, 2_000


def byte_weights() -> np.ndarray:
    """256 fixed pseudo-random odd weights."""
    x = np.arange(1, 257, dtype=np.uint32) * np.uint32(0x9E3779B9)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    return (x ^ (x >> np.uint32(13))) | np.uint32(1)


WEIGHTS = byte_weights()


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one its length; never inside a character."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(raw, np.uint8)
    h, w, m = WEIGHTS[b], 1, 0x01000193
    while w < WINDOW and len(h) > w:
        h = h[:-w] + h[w:] * np.uint32(m)
        w, m = 2 * w, m * m & 0xFFFFFFFF
    ends = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + w
    out, last = [], 0
    for e in [*ends.tolist(), n]:
        while e - last > MOST:
            last += MOST
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if e == n or e - last >= LEAST:
            while e < n and raw[e] & 0xC0 == 0x80:
                e += 1
            if e > last:
                out.append(e)
                last = e
    return out


def chunks(text: str) -> list[str]:
    raw = text.encode()
    ends = cuts(raw)
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends)]


class Encoded:
    """A chunk's own split: starts of its pre-tokens, their ids, and where each one's ids begin; ``safe`` pre-tokens no longer text can change."""

    __slots__ = ("starts", "ids", "offsets", "safe")

    def __init__(self, codec: pretokens.Codec, chunk: str):
        self.starts, self.ids, self.offsets = array("i"), array("i"), array("i")
        at, limit, self.safe = 0, len(chunk) - pretokens.LOOKAHEAD, 0
        pieces = codec.pattern.findall(chunk) if codec.regular(chunk) else codec.split(chunk, 0, len(chunk), False)
        for p in pieces:
            self.starts.append(at)
            self.offsets.append(len(self.ids))
            self.ids.extend(codec.piece(p))
            at += len(p)
            if at <= limit:
                self.safe += 1
        self.starts.append(at)
        self.offsets.append(len(self.ids))


class Cache(dict):
    """Encoded chunks, the one unused for longest first; ``hits`` and ``misses`` count the bytes looked for."""

    def __init__(self, most: int = CACHE_CHUNKS):
        self.most, self.hits, self.misses = most, 0, 0

    def of(self, codec: pretokens.Codec, chunk: str) -> Encoded:
        own = self.pop(chunk, None)
        if own is None:
            self.misses += len(chunk)
            own = Encoded(codec, chunk)
            if len(self) >= self.most:
                del self[next(iter(self))]
        else:
            self.hits += len(chunk)
        self[chunk] = own
        return own


def encode_part(codec: pretokens.Codec, text: str, reuse: Cache, shared: dict[str, Encoded]) -> array:
    """The ids of a text without special tokens, from its chunks."""
    parts, regular = chunks(text), codec.regular(text)
    out, base, first = array("i"), 0, 0  # first: the chunk's pre-token from which the whole text's split agrees with it
    at: int | None = None  # where the split of the whole text stands if it agrees with no chunk yet
    for k, chunk in enumerate(parts):
        own = shared.get(chunk) or reuse.of(codec, chunk)
        end = base + len(chunk)
        if at is not None:  # repair the join: split on until a boundary is one of this chunk's, too
            ours = own.starts
            i = 0
            while at < end:
                while ours[i] < at - base:
                    i += 1
                if ours[i] == at - base:
                    break
                piece = codec.pattern.match(text, at)[0] if regular else next(codec.split(text, at, len(text), False))
                out.extend(codec.piece(piece))
                at += len(piece)
            if at >= end:
                base = end
                continue
            first, at = i, None
        last = len(own.starts) - 1 if k == len(parts) - 1 else max(first, own.safe)
        out.extend(own.ids[own.offsets[first] : own.offsets[last]])
        at = base + own.starts[last]
        base, first = end, 0
    return out


def encode_text(codec: pretokens.Codec, text: str, reuse: Cache, shared: dict[str, Encoded]) -> array:
    out = array("i")
    for part, special in codec.parts(text):
        if special is not None:
            out.append(special)
        else:
            out.extend(encode_part(codec, part, reuse, shared))
    return out


def worth_most(worth: DataFrame) -> DataFrame:
    """Of (key, size, worth) the keys worth most: at most DICTIONARY_CHUNKS and DICTIONARY_BYTES, the last step of worth filled by hash.

    Steps of worth are eighths of a power of two, so that the driver sees some hundred sums and nothing is sorted.
    """
    stepped = worth.withColumn("step", F.floor(8 * F.log2("worth")))
    steps = stepped.groupBy("step").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy(F.desc("step")).collect()
    chunks_left, bytes_left = DICTIONARY_CHUNKS, DICTIONARY_BYTES
    for r in steps:
        if r["n"] > chunks_left or r["size"] > bytes_left:
            part = min(chunks_left / r["n"], bytes_left / r["size"])
            return stepped.where((F.col("step") > r["step"]) | ((F.col("step") == r["step"]) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(part * (1 << 20)))))
        chunks_left, bytes_left = chunks_left - r["n"], bytes_left - r["size"]
    return stepped


def dictionary(spark: SparkSession, texts: DataFrame) -> list[str]:
    """The chunks worth most over all documents."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = Counter(raw[a:b] for raw in common.bytes_of(batch.column(0)) for ends in (cuts(raw),) for a, b in zip([0, *ends], ends))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(c) for c in found], pa.binary()), pa.array([len(c) for c in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["key", "size", "n"])

    counted = texts.mapInArrow(count, "key binary, size long, n long").groupBy("key").agg(F.max("size").alias("size"), F.sum("n").alias("n")).where("n > 1")
    worth = common.cut_lineage(spark, counted.withColumn("worth", F.col("size") * (F.col("n") - 1)))
    keys = {bytes(r["key"]) for r in worth_most(worth).select("key").collect()}  # DICTIONARY_CHUNKS
    if not keys:
        return []
    wanted = spark.sparkContext.broadcast(keys)

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in it:
            found = {}
            for raw in common.bytes_of(batch.column(0)):
                ends = cuts(raw)
                for a, b in zip([0, *ends], ends):
                    if (key := xxhash.xxh3_128_digest(raw[a:b])) in wanted.value and key not in sent:
                        sent.add(key)
                        found[key] = raw[a:b].decode()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.string())], names=["key", "chunk"])

    rows = texts.mapInArrow(fetch, "key binary, chunk string").groupBy("key").agg(F.min("chunk").alias("chunk"))
    return [r["chunk"] for r in rows.select("chunk").collect()]  # DICTIONARY_BYTES


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, with the vocabulary at ``path``."""
    common.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    vocabulary = spark.sparkContext.broadcast(pretokens.vocabulary(path))
    frequent = dictionary(spark, rows.select("text"))
    codec = pretokens.codec(vocabulary.value)
    shared = spark.sparkContext.broadcast({c: Encoded(codec, c) for c in frequent})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, reuse = pretokens.codec(vocabulary.value), Cache()
        for batch in it:
            texts = common.texts_of(batch.column(1))
            at = 0
            while at < len(texts):  # in slices, so that the ids of a batch of long texts stay small
                upto, size = at, 0
                while upto < len(texts) and size < 4 << 20:
                    size += len(texts[upto])
                    upto += 1
                ids = [encode_text(codec, t, reuse, shared.value) for t in texts[at:upto]]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([np.frombuffer(x, np.int32) for x in ids if len(x)] or [np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])
                at = upto
        common.trim_memory()

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text of every row."""
    common.prepare(spark)
    vocabulary = spark.sparkContext.broadcast(pretokens.vocabulary(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, ids = pretokens.codec(vocabulary.value), batch.column(1)
        flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        texts = [codec.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return common.map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decode(spark, encode(spark, common.table(spark, sf_dir, "documents"))))
