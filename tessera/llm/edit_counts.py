"""Token counts kept up to date under edits, by a segment tree of pre-tokens for each document.

A document is split into pre-tokens, whose BPE counts are independent of each other. Blocks of ``BLOCK`` pre-tokens are the leaves
of a tree whose inner nodes hold the sums of characters and tokens below. An edit (start, end, replacement) finds its leaves by
descending the sums. Re-encoding starts at the leaf that holds the last pre-token no text behind the edit's start can change,
and goes on until a boundary of the new split falls on a leaf's boundary behind the edit; from there on both splits agree, as the
pattern looks forward only. Edits that touch the same leaves, or that the next one could change, are merged and encoded once; so no batch of edits encodes more than the
text and the leaves' edges. The touched leaves are replaced and the sums on their paths updated; nothing else is encoded
again. Special tokens are pre-tokens of their own, and characters on which Unicode versions disagree are split by the library, piece by piece. Trees
are a table (doc_id, text, chars, tokens), so a later batch of edits starts from them.

Edits of one document all refer to its text before the batch; one that overlaps an earlier one or lies outside the text
is ignored, and of those with one start only the shortest counts (ties: the least replacement), so a document has no more edits than characters, however many rows
ask for them. Nulls: a null text is empty, a null replacement is the empty text, edits with a null id, start or end are ignored, documents with a null id
have no edits of a table. Repeated document rows each get the edits of their id. Very long texts are counted whole. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, pretokens

BLOCK = 64
Edit = tuple[int, int, str]
#: Replacement, a string without which there is no match, and what the masking edits replace.
MASKS = (
    ("<EMAIL>", "@", r"[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+"),
    ("<URL>", "://", r"https?://[^\s<>\"']+"),
    ("<NUMBER>", "", r"\+?\d(?:[\d .()/-]{3,30}\d)"),
    ("<SECRET>", "_", r"\b[A-Za-z]{2,6}_[A-Za-z0-9_]{16,}\b"),
)


class Tree:
    """Sums of (characters, tokens) over blocks of pre-tokens; level 0 holds the leaves, each further level the sums of pairs."""

    def __init__(self, leaves: np.ndarray):
        self.levels = [np.asarray(leaves, np.int64).reshape(-1, 2) if len(leaves) else np.zeros((1, 2), np.int64)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.concatenate([low, np.zeros((1, 2), np.int64)])
            self.levels.append(low[0::2] + low[1::2])

    @property
    def leaves(self) -> np.ndarray:
        return self.levels[0]

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at`` (the last leaf for the text's end), and the characters before that leaf."""
        i, before = 0, 0
        for level in reversed(self.levels[:-1]):
            i *= 2
            if i + 1 < len(level) and at >= before + level[i, 0]:
                before += int(level[i, 0])
                i += 1
        return i, before

    def replaced(self, changes: list[tuple[int, int, np.ndarray]]) -> "Tree":
        """The tree with leaves first..last replaced by others, for every change; it is built again only if new leaves don't fit in their place."""
        if any(len(new) > last - first + 1 for first, last, new in changes):
            parts, at = [], 0
            for first, last, new in changes:
                parts += [self.leaves[at:first], new]
                at = last + 1
            return Tree(np.concatenate([*parts, self.leaves[at:]]))
        for first, last, new in changes:
            for k in range(first, last + 1):
                leaf, delta = k, (new[k - first] if k - first < len(new) else np.zeros(2, np.int64)) - self.leaves[k]
                for level in self.levels:
                    level[leaf] += delta
                    leaf >>= 1
        return self


def blocks(codec: pretokens.Codec, pieces: Iterable[tuple[str, int | None]]) -> np.ndarray:
    sizes = np.array([(len(p), len(codec.piece(p)) if special is None else 1) for p, special in pieces], np.int64).reshape(-1, 2)
    return np.add.reduceat(sizes, np.arange(0, len(sizes), BLOCK)) if len(sizes) else sizes


def grow(codec: pretokens.Codec, text: str) -> Tree:
    return Tree(blocks(codec, codec.walk(text, 0, codec.specials_in(text), codec.regular(text))))


def accepted(text: str, edits: list[Edit]) -> list[Edit]:
    """The edits that lie in the text and overlap none before, by start; of those with one start the first."""
    kept, last, before = [], 0, -1
    for e in sorted(edits):
        if last <= e[0] <= e[1] <= len(text) and e[0] != before:
            kept.append(e)
            before, last = e[0], e[1]
    return kept


def apply_edits(codec: pretokens.Codec, text: str, tree: Tree, edits: list[Edit]) -> tuple[str, Tree, int]:
    """The edited text, its tree, and the characters that were encoded again: one pass from the first edit to the last."""
    edits = accepted(text, edits)
    if not edits:
        return text, tree, 0
    pieces, at = [], 0
    for start, end, new in edits:
        pieces += [text[at:start], new]
        at = end
    result = "".join([*pieces, text[at:]])
    specials, regular = codec.specials_in(result), codec.regular(result)
    back = pretokens.LOOKAHEAD + 1 + max(map(len, codec.specials), default=0)
    ends = np.cumsum(tree.leaves[:, 0]).tolist()  # of the leaves, in the old text
    n, shift, again, k = len(ends), 0, 0, 0
    changes: list[tuple[int, int, np.ndarray]] = []
    while k < len(edits):
        first, old = tree.find(max(0, edits[k][0] - back))
        at, last, found = old + shift, first, []
        split = codec.walk(result, at, specials, regular)
        while True:
            while k < len(edits) and edits[k][0] - back < ends[last]:  # this edit belongs to the leaves in hand
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                last = max(last, tree.find(edits[k][1])[0])
                k += 1
            if at == ends[last] + shift or at >= len(result):
                break
            if at > ends[last] + shift and last + 1 < n:
                last += 1
                continue
            found.append(next(split))
            at += len(found[-1][0])
        if at >= len(result):
            last, k = n - 1, len(edits)
        again += sum(len(p) for p, _ in found)
        changes.append((first, last, blocks(codec, found)))
    return result, tree.replaced(changes), again


def trees(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text and its tree's leaves: chars and tokens (arrays of long) by block."""
    common.prepare(spark)
    vocabulary = spark.sparkContext.broadcast(pretokens.vocabulary(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, texts = pretokens.codec(vocabulary.value), common.texts_of(batch.column(1))
        leaves = [grow(codec, t).leaves for t in texts]
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([x[:, 0] for x in leaves], kind), pa.array([x[:, 1] for x in leaves], kind)], names=["doc_id", "text", "chars", "tokens"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, text string, chars array<long>, tokens array<long>")


def recount(spark: SparkSession, grown: DataFrame, edits: DataFrame | Callable[[str], list[Edit]], path: str | None = None) -> DataFrame:
    """Applies edits to a table of ``trees``: its columns after the edits, and n_before, n_after, n_edits, n_chars, n_encoded_again.

    ``edits`` is a table (doc_id, start, end, replacement), or a function that derives a text's edits from the text itself;
    the function needs no join.
    """
    common.prepare(spark)
    vocabulary = spark.sparkContext.broadcast(pretokens.vocabulary(path))
    rows = grown.select("doc_id", "text", "chars", "tokens")
    derive = None if isinstance(edits, DataFrame) else edits
    if derive is None:
        wanted = edits.select(F.col("doc_id").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), F.coalesce(F.col("replacement").cast("string"), F.lit("")).alias("new")).where("doc_id is not null and 0 <= start and start <= end")
        wanted = wanted.groupBy("doc_id", "start").agg(F.min(F.struct("end", "new")).alias("e"))
        sizes = grown.groupBy("doc_id").agg(F.max(F.length("text")).alias("size"))
        inside = wanted.join(sizes, "doc_id").where("e.end <= size")
        listed = inside.groupBy("doc_id").agg(F.collect_list(F.struct("start", "e.end", "e.new")).alias("edits"))  # at most one edit a character
        rows = rows.join(listed, "doc_id", "left")  # one document's edits come together, as its text does

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, out = pretokens.codec(vocabulary.value), []
        ids, texts = batch.column(0).to_pylist(), common.texts_of(batch.column(1))
        given = batch.column(4).to_pylist() if derive is None else [None] * len(ids)
        for doc_id, text, chars, tokens, own in zip(ids, texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), given):
            tree = Tree(np.stack([np.array(chars, np.int64), np.array(tokens, np.int64)], 1))
            todo = derive(text) if derive is not None else [(e["start"], e["end"], e["new"]) for e in own or ()]
            before = tree.tokens
            after, tree, again = apply_edits(codec, text, tree, todo)
            out.append((doc_id, after, tree.leaves[:, 0], tree.leaves[:, 1], before, tree.tokens, len(accepted(text, todo)), len(after), again))
        kind = pa.list_(pa.int64())
        cols = list(zip(*out)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), kind, kind, *[pa.int64()] * 5))], names=["doc_id", "text", "chars", "tokens", "n_before", "n_after", "n_edits", "n_chars", "n_encoded_again"])

    return common.map_batches(rows, run, "doc_id long, text string, chars array<long>, tokens array<long>, n_before long, n_after long, n_edits long, n_chars long, n_encoded_again long")


def masking_edits(text: str) -> list[Edit]:
    """Edits that mask addresses, numbers and keys."""
    out: list[Edit] = []
    digits = regex.search(r"\d", text) is not None
    for new, sign, pattern in MASKS:
        if sign in text if sign else digits:
            out += [(*m.span(), new) for m in regex.finditer(pattern, text)]
    return out


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its masking edits."""
    grown = trees(spark, common.table(spark, sf_dir, "documents"))
    return recount(spark, grown, masking_edits).select("doc_id", F.col("n_before").alias("n_tokens"), "n_edits", F.col("n_after").alias("n_tokens_masked"), F.col("n_chars").alias("n_chars_masked"), "n_encoded_again")
