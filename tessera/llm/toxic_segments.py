"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are runs of word characters, lower-cased. A token's score is the log-odds of the most specific unit known
for it (the word, else its first six, else its first four characters), under a symmetric-plus-background Dirichlet
prior; units whose log-likelihood ratio is below ``MIN_LLR`` score zero, and every token pays a small drift, so that
the expected score of clean text is negative. One linear scan (Ruzzo and Tompa) yields all maximal segments. Segment
scores of clean text follow an extreme-value law: E = K n exp(-lambda S); lambda solves E[exp(lambda x)] = 1 over
clean tokens and K is its maximum-likelihood value on clean training documents. A document's evidence is the
sum of -log10 E over all its segments with E < 1, turned into a probability by a logistic fit; the fit and the scores use the same
evidence, from whole texts.

Learning uses a bounded sample of labelled rows, chosen by the hash of the id: on average ``MAX_CLEAN`` clean and ``MAX_TOXIC`` toxic
documents of ``MAX_BYTES`` altogether, or all if there are fewer. The units sent to the tasks each occur in ``LEAST`` of these documents or more, so their number is
bounded by the sample, too. Scores see the text only.

Nulls: a null text is empty and scores as no evidence; a null id is scored like any other; labels with a null id or
label are ignored, repeated labels are toxic if any is. Repeated rows are scored row by row. Without labels of both classes
every score is the share of toxic labels (0 without labels). An empty table gives an empty result. No result hangs on ties: units are chosen by
thresholds, not by rank, and copies in the sample are equal in all that is counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Bounds of the training sample: documents of each class, and bytes of text.
MAX_CLEAN, MAX_TOXIC, MAX_BYTES = 20_000, 10_000, 256 << 20
#: Documents of the sample that a unit must occur in to be in the model.
LEAST = 4
MIN_LLR, DRIFT, PRIOR_FLOOR, PRIOR_MASS, CLIP = 30.0, 0.05, 0.5, 200.0, 8.0
TOKEN = re.compile(r"\w+")
#: Words held by a scoring task's cache before it starts afresh.
CACHE_WORDS = 300_000


def units_of(word: str) -> tuple[str, ...]:
    """A token's units, most specific first."""
    if len(word) > 6:
        return "w" + word, "6" + word[:6], "4" + word[:4]
    return ("w" + word, "4" + word[:4]) if len(word) > 4 else ("w" + word,)


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence given by its non-drift positions.

    ``scores`` holds (position, score) in order; every other position scores ``-drift``. One pass over the positive
    scores. Every candidate keeps a link to its last predecessor with a lesser sum before it: all between them begin no lower, so a search
    skips them, and each candidate is skipped or merged at most once. That makes the scan linear, as in Ruzzo and Tompa's method.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link
    total, at = 0.0, 0
    for pos, s in scores:
        total -= drift * (pos - at)
        at = pos + 1
        before, total = total, total + s
        if s <= 0:
            continue
        first, low, high = pos, before, total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            link = found[j][4]
            del found[j:]
            j = link
        found.append((first, pos, low, high, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    bias: float = -30.0

    def word(self, word: str) -> float:
        for u in units_of(word):
            if (x := self.odds.get(u)) is not None:
                return x
        return 0.0

    def scan(self, text: str, cache: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and the segments."""
        words = TOKEN.findall(text.lower())
        try:
            scores = [cache[w] for w in words]
        except KeyError:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = self.word(w)
            scores = [cache[w] for w in words]
        x = np.array(scores)
        hot = np.flatnonzero(x)
        if not hot.size or x.max() <= 0:
            return len(words), []
        return len(words), maximal_segments([(i, s - DRIFT) for i, s in zip(hot.tolist(), x[hot].tolist())], DRIFT)

    def log_e(self, n: int, score: float) -> float:
        """log10 of the expected number of clean segments of that score."""
        return math.log10(max(self.k * max(n, 1), 1e-300)) - self.lam * score / math.log(10)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        return sum(max(0.0, -self.log_e(n, s)) for _, _, s in segments)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(evidence)))))


def likeness(raw: bytes) -> int:
    """The least hash of a text's five-word shingles: equal for copies, and for near copies as often as their shingles agree."""
    words = raw.lower().split()
    return min((xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) - (1 << 63)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the bounded training sample; of copies and near copies mostly one, as their words would else look telling."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("_toxic")).where("doc_id is not null and _toxic is not null").groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
    known = known.where(common.crc_bucket(F.col("doc_id"), 3) != 1)
    known = known.withColumn("_toxic", (F.col("_toxic") == 1).cast("int"))
    many = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    parts = [common.hash_sample(known.where(F.col("_toxic") == y), many.get(y, 0), most, "doc_id") for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    few = parts[0].unionByName(parts[1])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id")  # MAX_TOXIC + MAX_CLEAN ids on average at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([likeness(t) for t in common.bytes_of(batch.column(0))], pa.int64())], names=["text", "toxic", "copy"])

    rows = common.map_batches(rows.select("text", F.col("_toxic").alias("toxic")), run, "text string, toxic int, copy long")
    kept = common.written(docs.sparkSession, rows.dropDuplicates(["copy", "toxic"]), "toxic-sample")
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return kept if size <= MAX_BYTES else common.hash_sample(kept, size, MAX_BYTES, "copy", "toxic")


def count_units(rows: DataFrame) -> DataFrame:
    """unit, toxic documents, clean documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(common.texts_of(batch.column(0)), batch.column(1).to_pylist()):
                for u in {u for w in set(TOKEN.findall(text.lower())) for u in units_of(w)}:
                    found[u][toxic != 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], names=["unit", "t", "c"])

    return rows.mapInArrow(run, "unit string, t long, c long").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def log_odds(spark: SparkSession, counts: DataFrame) -> dict[str, float]:
    """Scores of the significant units, and zero for frequent clean words that would inherit a significant prefix.

    All of them occur in LEAST documents or more, so there are fewer than the sample's bytes divided by LEAST.
    """
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    nt, nc = float(total["t"] or 0), float(total["c"] or 0)
    if nt == 0 or nc == 0:
        return {}
    t, c, n = F.col("t").cast("double"), F.col("c").cast("double"), nt + nc
    prior = F.lit(PRIOR_FLOOR) + PRIOR_MASS * (t + c) / n
    odds = F.log((t + prior) / (nt + PRIOR_MASS - t)) - F.log((c + prior) / (nc + PRIOR_MASS - c))
    part = lambda x, of: F.when(x > 0, x * F.log(x / ((t + c) * (of / n)))).otherwise(0.0)
    scored = counts.withColumns({"odds": F.greatest(F.lit(-1.0), F.least(F.lit(CLIP), odds)), "llr": 2 * (part(t, nt) + part(c, nc))})
    kept = scored.where((F.col("llr") >= MIN_LLR) & (t + c >= LEAST)).select("unit", "odds").collect()
    found = {r["unit"]: r["odds"] for r in kept}
    prefixes = [u for u in found if u[0] != "w"]
    if prefixes:
        heads = spark.createDataFrame([(u,) for u in prefixes], "head string")
        plain = scored.where(F.col("unit").startswith("w") & (F.col("llr") < MIN_LLR) & (F.col("c") > LEAST))
        plain = plain.withColumn("head", F.explode(F.array(F.concat(F.lit("4"), F.substring("unit", 2, 4)), F.concat(F.lit("6"), F.substring("unit", 2, 6)))))
        found |= {r["unit"]: 0.0 for r in plain.join(heads, "head", "left_semi").select("unit").distinct().collect()}
    return found


def newton_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias, slightly regularised."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def scanned(rows: DataFrame, model: Model, what: str) -> DataFrame:
    """Of every training row: toxic and either "clean" (n, best segment and the scores' histogram of clean texts) or its "evidence"."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in it:
            out: list[tuple] = []
            for text, toxic in zip(common.texts_of(batch.column(0)), batch.column(1).to_pylist()):
                if what == "clean" and toxic == 1:
                    continue
                n, segments = shared.value.scan(text, cache)
                if what == "clean":
                    hist = Counter(round(cache[w], 2) for w in TOKEN.findall(text.lower()))
                    out.append((max(n, 1), max((s for _, _, s in segments), default=0.0), list(hist), list(hist.values())))
                else:
                    out.append((toxic, shared.value.evidence(n, segments)))
            kinds = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())) if what == "clean" else (pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=["n", "best", "x", "m"] if what == "clean" else ["toxic", "evidence"])

    return rows.mapInArrow(run, "n long, best double, x array<double>, m array<long>" if what == "clean" else "toxic int, evidence double")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels)
    counts = common.cut_lineage(spark, count_units(rows))
    model = Model(log_odds(spark, counts))
    many = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean = common.cut_lineage(spark, scanned(rows, model, "clean"))
    hist = clean.select(F.explode(F.arrays_zip("x", "m")).alias("z")).groupBy(F.col("z.x").alias("x")).agg(F.sum("z.m").alias("m")).orderBy("x").collect()  # scores of two decimals
    if not many.get(1) or not many.get(0) or not hist:
        share = many.get(1, 0) / sum(many.values()) if many else 0.0
        model.bias = 30.0 if share == 1 else -30.0 if share == 0 else math.log(share / (1 - share))
        return model
    x, m = np.array([r["x"] for r in hist]) - DRIFT, np.array([r["m"] for r in hist], float)
    m /= m.sum()
    low, high = 1e-6, 20.0
    if x.max() > 0:
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if (m * np.exp(np.minimum(mid * x, 600))).sum() < 1 else (low, mid)
        model.lam = max(low, 0.05)
    model.k = many[0] / max(clean.agg(F.sum(F.col("n") * F.exp(-model.lam * F.col("best")))).first()[0], 1e-9)
    seen = scanned(rows, model, "evidence").toArrow().sort_by([("evidence", "ascending"), ("toxic", "ascending")])  # two numbers a sampled document
    model.slope, model.bias = newton_logistic(np.log1p(seen["evidence"].to_numpy()), (seen["toxic"].to_numpy() == 1).astype(float))
    return model


def passages(docs: DataFrame, model: Model, max_e: float = 0.05) -> DataFrame:
    """Every significant passage: doc_id, first character, end, passage, score, log10 of its E value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in it:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1))):
                low = text.lower()
                n, segments = shared.value.scan(text, cache)
                spans = [x.span() for x in TOKEN.finditer(low)] if segments else []
                for a, b, s in segments:
                    if (e := shared.value.log_e(n, s)) <= math.log10(max_e):
                        start, end = spans[a][0], spans[b][1]
                        out.append((doc_id, start, end, low[start:end], s, e))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "start", "end", "passage", "score", "log10_e"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, end long, passage string, score double, log10_e double")


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, and _passages (how many are significant) and _score; columns of these names are replaced."""
    docs = docs.drop("_passages", "_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    plain = docs.withColumn("text", F.col("text").cast("string")).select("*", F.lit(0).cast("long").alias("_passages"), F.lit(0.0).alias("_score"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in it:
            many, scores = [], []
            for text in common.texts_of(batch.column(at)):
                n, segments = shared.value.scan(text, cache)
                many.append(sum(shared.value.log_e(n, s) <= math.log10(0.05) for _, _, s in segments))
                scores.append(shared.value.probability(shared.value.evidence(n, segments)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(many, pa.int64()), pa.array(scores, pa.float64())], names=batch.schema.names)
        common.trim_memory()

    return plain.mapInArrow(run, plain.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(spark, docs, common.table(spark, sf_dir, "labels"))
    held = (common.crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out")
    out = with_scores(docs, model).select("doc_id", held, F.col("_score").alias("score"), F.col("_passages").alias("n_passages"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")
