"""Quality rules whose cutoffs are chosen under a guaranteed false-rejection rate.

Each rule rejects a document when a ratio reaches a cutoff; a document goes if any of its stratum's rules rejects it. Strata are languages. Labelled
documents that pass the base rule are split by the md5 of the text, a text counting once however often it occurs:

* a quarter tunes: each rule takes the cutoff with the most bad documents rejected, less ten times the good ones; rules without a gain stay
  off, and the others are ordered by gain. Policy j is the union of the first j rules, so policies are nested.
* the rest is the holdout: policies are tested in order by the exact binomial tail P(Bin(n, risk) <= k), k good documents rejected by the whole union out
  of n. Testing stops at the first failure (fixed-sequence testing, so the rules and the grid cost nothing), and the level ``delta`` is shared over all strata that have
  enough good documents to certify anything (Bonferroni).

So with probability 1 - ``delta``, in no stratum do all rules together reject more than ``risk`` of the good documents. The longest certified policy is used; a
stratum without one is held to the base rule only.

Nulls: a null text counts as empty and fails the base rule; a null language is a stratum of its own, apart from the empty one; labels with a null id or
quality are ignored, a text whose labels disagree counts as bad. Repeated document rows are judged row by row. Ties between cutoffs go to the milder, between rules
to the first of ``GRID``. Very long texts are measured whole. An empty table gives an empty result, and empty labels switch all learned rules off.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Rule name -> candidate cutoffs, mildest first; a document is rejected when the feature is >= the cutoff.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.5, 0.35, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02),
    "dup_line_ratio": (0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05),
    "upper_ratio": (0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "mean_word_chars": (30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0),
    "marks_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25),
}

#: Texts whose md5 begins with one of these digits tune; all others are the holdout.
TUNING = "0123"
#: Strata with certified rules that are sent to every task at most; more are joined by a shuffle.
BROADCAST_STRATA = 10_000

UPPER = regex.compile(r"\p{Lu}")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long"


def measure(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of MEASURES."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly 0x20 and 0x09-0x0D
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    marks = len(raw) - len(raw.translate(None, b"!?"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            until = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    upper = len(UPPER.findall(text)) if not text.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, upper, marks


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, digest (md5 of the text) and the counts of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*map(measure, common.texts_of(batch.column(2))))) or [()] * 7
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "lang", "digest", *(x.split()[0] for x in MEASURES.split(", "))])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return common.map_batches(docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.col("text").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("digest")), run, f"doc_id long, lang string, digest string, {MEASURES}")


def with_features(df: DataFrame) -> DataFrame:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return df.withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / chars,
            "dup_line_ratio": F.col("n_dup_lines") / words,
            "repeat_ratio": F.col("n_repeat_words") / words,
            "upper_ratio": F.col("n_upper") / chars,
            "mean_word_chars": F.col("word_chars") / words,
            "marks_per_word": F.col("n_marks") / words,
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly up to rounding: terms are summed from k away from the mode, until they no longer matter."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    log_term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    below = k <= n * p
    i = k if below else k + 1
    term = total = math.exp(log_term(i))
    while term > total * 1e-18 and (i > 0 if below else i < n):
        term *= i / (n - i + 1) * (1 - p) / p if below else (n - i) / (i + 1) * p / (1 - p)
        i += -1 if below else 1
        total += term
    return min(1.0, total if below else 1 - total)


def least_good(risk: float, delta: float) -> int:
    """Good documents of the holdout without which nothing can be certified, even if none is rejected and no other stratum is tested."""
    return math.ceil(math.log(delta) / math.log1p(-risk))


@dataclass(frozen=True)
class Policy:
    """A stratum's certified rules with their cutoffs, and what they do to the holdout."""

    lang: str | None
    cutoffs: dict[str, float]
    good: int
    good_rejected: int
    p_value: float


def certified(rejected: list[int], n_good: int, risk: float, level: float) -> int:
    """How many policies in a row are certified, from the good documents that each one rejects."""
    for j, k in enumerate(rejected):
        if n_good == 0 or binomial_tail(k, n_good, risk) > level:
            return j
    return len(rejected)


def fit(features: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.1) -> list[Policy]:
    """The certified policy of every stratum that has one, from all labelled texts that pass the base rule."""
    spark = features.sparkSession
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("_q")).where("doc_id is not null and _q is not null").groupBy("doc_id").agg(F.min("_q").alias("_q"))
    held = features.where(~F.col("base_failed")).join(known, "doc_id")
    texts = held.groupBy("lang", "digest").agg(F.min("_q").alias("_q"), *[F.first(r).alias(r) for r in GRID])  # equal texts have equal ratios
    texts = common.cut_lineage(spark, texts.withColumn("_tune", F.substring("digest", 1, 1).isin(*TUNING)))
    good, bad, hold = F.col("_q") == 1, F.col("_q") != 1, ~F.col("_tune")
    gains = [F.sum(((F.col(rule) >= c) & F.col("_tune")).cast("long") * F.when(bad, 1).otherwise(-10)).alias(f"{rule}_{i}") for rule, cutoffs in GRID.items() for i, c in enumerate(cutoffs)]
    strata = texts.groupBy("lang").agg(F.sum((good & hold).cast("long")).alias("n_good"), *gains)
    rows = strata.where(F.col("n_good") >= least_good(risk, delta)).collect()  # at most one for each least_good labels
    ladders = {}
    for r in rows:
        best = [max((r[f"{rule}_{i}"] or 0, -i, rule, c) for i, c in enumerate(cutoffs)) for rule, cutoffs in GRID.items()]
        order = sorted((x for x in best if x[0] > 0), key=lambda x: (-x[0], list(GRID).index(x[2])))
        ladders[r["lang"]] = [(rule, c) for _, _, rule, c in order]
    steps = [(lang, j, rule, c) for lang, own in ladders.items() for j, (rule, c) in enumerate(own)]
    if not steps:
        return []
    ladder = spark.createDataFrame(steps, "_l string, _j int, _rule string, _c double")
    ladder = ladder.groupBy("_l").agg(*[F.max(F.when(F.col("_rule") == rule, F.struct("_j", "_c"))).alias(f"_{rule}") for rule in GRID])
    first = F.least(*[F.when(F.col(rule) >= F.col(f"_{rule}._c"), F.col(f"_{rule}._j")) for rule in GRID])  # the first policy that rejects the text
    found = texts.where(good & hold).join(ladder, F.col("lang").eqNullSafe(F.col("_l"))).groupBy("lang", first.alias("first")).count().where("first is not null").collect()
    level, out = delta / len(rows), []
    for r in rows:
        own, by = ladders[r["lang"]], {x["first"]: x["count"] for x in found if x["lang"] == r["lang"]}
        rejected = [sum(by.get(i, 0) for i in range(j + 1)) for j in range(len(own))]
        if n := certified(rejected, r["n_good"], risk, level):
            out.append(Policy(r["lang"], dict(own[:n]), r["n_good"], rejected[n - 1], binomial_tail(rejected[n - 1], r["n_good"], risk)))
    return out


def judge(features: DataFrame, policies: list[Policy]) -> DataFrame:
    """Adds ``kept`` and ``failed_rules``; strata without a policy are held to the base rule only."""
    rows = [(p.lang, *(p.cutoffs.get(rule) for rule in GRID)) for p in policies]
    own = features.sparkSession.createDataFrame(rows, "_l string, " + ", ".join(f"_{rule} double" for rule in GRID))
    joined = features.join(F.broadcast(own) if len(rows) <= BROADCAST_STRATA else own, F.col("lang").eqNullSafe(F.col("_l")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(rule) >= F.col(f"_{rule}"), F.lit(rule)) for rule in GRID]))
    return joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_l", *[f"_{rule}" for rule in GRID])


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.1) -> DataFrame:
    """Every document with its counts and verdict."""
    common.prepare(spark)
    features = with_features(common.cut_lineage(spark, measures(docs)))
    return judge(features, fit(features, labels, risk, delta))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql(risk: float = 0.02, delta: float = 0.1) -> str:
    """The same rows in DuckDB's SQL: counts, tuned cutoffs, nested policies, exact tails, fixed-sequence choice and verdicts."""
    grid = ", ".join(f"('{rule}', {r}, {i}, {c}::double)" for r, (rule, cutoffs) in enumerate(GRID.items()) for i, c in enumerate(cutoffs))
    value = "case rule " + " ".join(f"when '{r}' then {r}" for r in GRID) + " end"
    return f"""
with d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text from documents),
w as (select r, doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from d),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
t as (select r, u.i, words[u.i : u.i + 2] as win from w, unnest(range(1, len(words) - 1)) as u(i)),
tc as (select r, i, count(*) over (partition by r, win) as many from t),
rep as (select r, count(distinct i + v.k) as n_repeat_words from tc, (values (0), (1), (2)) as v(k) where many > 1 group by 1),
m as (select r, doc_id, lang, md5(text) as digest, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
 coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) as n_upper, length(regexp_replace(text, '[^!?]', '', 'g')) as n_marks
 from w left join dup using (r) left join rep using (r)),
f as (select *, n_symbols / greatest(word_chars, 1) as symbol_ratio, n_dup_lines / greatest(n_words, 1) as dup_line_ratio, n_repeat_words / greatest(n_words, 1) as repeat_ratio,
 n_upper / greatest(word_chars, 1) as upper_ratio, word_chars / greatest(n_words, 1) as mean_word_chars, n_marks / greatest(n_words, 1) as marks_per_word, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
known as (select doc_id, min(quality) as q from labels where doc_id is not null and quality is not null group by 1),
held as (select lang, digest, substr(digest, 1, 1) in ({", ".join(f"'{x}'" for x in TUNING)}) as tune, min(q) as q, {", ".join(f"any_value({r}) as {r}" for r in GRID)} from f join known using (doc_id) where not base_failed group by all),
strata as (select lang, count(*) filter (q = 1 and not tune) as n from held group by 1 having n >= {least_good(risk, delta)}),
level as (select {delta} / greatest(1, count(*)) as level from strata),
g as (select * from (values {grid}) as x(rule, place, i, cutoff)),
gains as (select lang, rule, place, i, cutoff, sum(case when tune and ({value}) >= cutoff then case when q = 1 then -10 else 1 end else 0 end) as gain from held, g group by all),
best as (select *, row_number() over (partition by lang, rule order by gain desc, i) as k from gains),
ladder as (select lang, rule, cutoff, row_number() over (partition by lang order by gain desc, place) as j from best where k = 1 and gain > 0),
first as (select h.lang, h.digest, min(l.j) as j from held h join ladder l on h.lang is not distinct from l.lang where q = 1 and not tune and ({value}) >= cutoff group by all),
rejected as (select l.lang, l.j, (select count(*) from first x where x.lang is not distinct from l.lang and x.j <= l.j) as k from ladder l),
tails as (select r.lang, r.j, case when r.k >= s.n then 1
 else (select sum(exp(lgamma(s.n + 1) - lgamma(v.i + 1) - lgamma(s.n - v.i + 1) + v.i * ln({risk}) + (s.n - v.i) * ln(1 - {risk}))) from unnest(range(0, r.k + 1)) as v(i)) end as p from rejected r join strata s on r.lang is not distinct from s.lang),
certified as (select a.lang, a.j from tails a, level where not exists (select 1 from tails b where b.lang is not distinct from a.lang and b.j <= a.j and b.p > level.level)),
failed as (select distinct f.r from f join ladder l on f.lang is not distinct from l.lang join certified c on c.lang is not distinct from l.lang and c.j = l.j where ({value}) >= cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r not in (select r from failed) as kept from f
"""
