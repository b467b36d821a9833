"""A corpus pipeline: each stage applies one operator to all that the stage before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each one's rows as Parquet into the shared checkpoint
folder and rereads them as the next one's documents. Every stage but the last returns the columns of ``documents``; columns it had besides
are kept. Rows with null texts pass the filters as empty texts; a document whose text a stage shortens keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chunk_bpe, common, near_copies, suffix_index, template_leaks, toxic_segments

#: A document is rejected as toxic from this score on.
TOXIC = 0.7


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, _mark (tells rows of one id apart), and all columns but the text in _rest, where no name can clash."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_mark"), F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"))


def _unpacked(rows: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    return rows.select(*[changed.get(c, F.col("text") if c == "text" else F.col("_rest").getField(c)).alias(c) for c in names])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the labelled ones among them."""
    common.prepare(spark)
    rows = _packed(docs)
    model = toxic_segments.fit(spark, rows, common.table(spark, sf_dir, "labels"))
    return _unpacked(toxic_segments.with_scores(rows, model).where(F.col("_score") < TOXIC), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 or more on 5-word shingles: that with the smallest id (equal ids: the smallest text hash; equal rows: one)."""
    groups = near_copies.groups(spark, docs)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th"))
    out = _packed(docs).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_th")), "left_semi")
    if groups.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "_mark"])
    return _unpacked(out, docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the byte strings that repeat; a character cut in two goes as a whole, and n_chars follows."""
    cut = suffix_index.deduplicated(spark, _packed(docs).drop("_mark"), as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return _unpacked(cut, docs.columns, **changed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no benchmark item."""
    leaking = template_leaks.leaking_documents(spark, docs, common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    out = _packed(docs).withColumn("_mark", mark).join(leaking, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_th")), "left_anti")
    return _unpacked(out, docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's token count, and digests of its ids and of the decoded text."""
    return chunk_bpe.digests(chunk_bpe.decode(spark, chunk_bpe.encode(spark, docs)))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("decontamination", decontamination),
    ("bpe_encoding", encoding),
]

#: SQL expresses neither the learned toxicity scores nor the tokens; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
