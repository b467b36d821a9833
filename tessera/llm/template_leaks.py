"""Benchmark decontamination by templates: items are found again even with other numbers, names and units.

Texts are made canonical with DataFrame functions only, in two ways: as they stand (case, punctuation and symbols go), and as templates, where numbers
(figures and number words), the units behind figures, and names become typed placeholders. A name is a run of capitalised words, at the beginning of a
sentence as well as inside; as a template it is one token. Windows of ``WIDTH`` canonical tokens (a whole item, if it has 5 to 7)
are hashed and equi-joined with the benchmark's windows, which are broadcast if there are at most ``BROADCAST_ROWS`` of
them and shuffled otherwise. A document leaks an item if

* at least ``COVERAGE`` of the item's windows occur in it as they stand, or
* at least ``COVERAGE`` of the item's template windows occur in it (those with at least half plain words), and the slots are consistent: every
  benchmark value stands for one and the same value of the document (at least ``AGREEMENT`` of the slot occurrences agree with the most
  frequent choice), in the whole document or in one occurrence of the item that is covered as far itself, or
* the item has fewer than ``LEAST_WORDS`` words and is a whole line of the document.

Items that read alike form a class under their smallest id, and so do, among templates, items whose slots differ only by their values: the check
can't tell these apart, and a benchmark of a thousand variants of one question multiplies nothing. Windows of a document are made distinct before
they meet the items, so a text that repeats one window a million times is counted once; places are looked up for covered items only, and never gathered into a row.

Nulls: a null text is empty; rows with a null id are searched and come back with a null id, items with a null id or without words are ignored. Rows of
one id and one text are one document in the result; texts of one id are told apart. Ties: the item of greatest coverage, then the one found as it stands, then the smallest
id. Very long texts are searched whole. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

WIDTH, LEAST_WORDS, COVERAGE, AGREEMENT = 8, 5, 0.3, 0.8
BROADCAST_ROWS = 500_000
#: Units that count as a slot when they follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s min h hr hrs meter meters metre metres kilometer kilometers inch inches foot feet yard yards mile miles gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degrees"
#: Words that are numbers.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
NUMBER, UNIT, NAME, JOINT = "\ue000", "\ue001", "\ue002", "\ue003"
#: Loops over groups are possessive here and below: nothing that follows them can match where they give back, and Java recurses for other loops, so that a long run would exhaust a task's stack and end its executor.
FIGURES = r"[0-9]+(?:[.,:/][0-9]+)*+"
#: One capitalised word: Alice, O'Neil, Smith-Jones; number words are none. It looks for the capital first, as that fails soonest at most places.
CAPITAL = r"(?=\p{Lu})(?<![\p{L}\p{N}])(?!(?:" + "|".join(w.capitalize() for w in NUMBER_WORDS.split()) + r")(?![\p{L}]))(?:\p{Lu}['\u2019])?\p{Lu}\p{Ll}+(?:['\u2019-]\p{L}\p{Ll}*)*+"
#: Removed from tokens: what is neither a letter, a digit, white space nor a placeholder.
NOISE = r"[^\p{L}\p{M}\p{N}\s" + NUMBER + UNIT + NAME + JOINT + "]+"
SPACE = "[ \t\n\x0b\f\r]+"
DOC = ["doc_id", "th"]


def _tokens(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), NOISE, ""), F.lit(" \t\n\x0b\f\r")), SPACE)


def plain_tokens(text: Column) -> Column:
    """The words as they stand; [''] if there are none."""
    return _tokens(text)


def joined_names(text: Column) -> Column:
    """Words of one name joined, so that they are one token."""
    return F.regexp_replace(text, rf"({CAPITAL})\s+(?=(?:\p{{Lu}}['\u2019])?\p{{Lu}}\p{{Ll}})", "$1" + JOINT)


def value_tokens(text: Column) -> Column:
    """As many tokens as ``template_tokens``, with the values of the slots."""
    return _tokens(joined_names(text))


def template_tokens(text: Column) -> Column:
    """Tokens with placeholders for numbers, units and names."""
    units = "|".join(UNITS.split())
    named = F.regexp_replace(joined_names(text), f"{CAPITAL}(?:{JOINT}{CAPITAL})*+", NAME)
    slots = F.regexp_replace(named, r"(?<![0-9])(?<![0-9][.,:/])" + FIGURES + rf"(\s+)(?:{units})(?![\p{{L}}\p{{N}}])", NUMBER + "$1" + UNIT)
    slots = F.regexp_replace(slots, FIGURES, NUMBER)
    return F.transform(_tokens(F.when(text.rlike("[0-9]"), slots).otherwise(named)), lambda t: F.when(t.isin(*NUMBER_WORDS.split()), F.lit(NUMBER)).otherwise(t))


def is_slot(token: Column) -> Column:
    return token.rlike(f"[{NUMBER}{UNIT}{NAME}]")


def with_windows(df: DataFrame, width: int) -> DataFrame:
    """Replaces ``tokens`` by ``windows``, the hashes of all windows of ``width`` tokens in order.

    Hashes of neighbours are joined pairwise, so that each step doubles the words a hash stands for: a few hashes a word
    in place of ``width``. Each step is a column of its own and evaluated once.
    """
    df = df.withColumn("_n", F.size("tokens")).withColumn("_h1", F.transform("tokens", lambda t: F.xxhash64(t))).drop("tokens")
    join = lambda a, b, shift: F.expr(f"zip_with({a}, slice({b}, {shift + 1}, greatest(_n, 0)), (x, y) -> xxhash64(x, y))")
    size, made = 1, ["_h1"]
    while 2 * size <= width:
        df = df.withColumn(f"_h{2 * size}", join(f"_h{size}", f"_h{size}", size))
        size *= 2
        made.append(f"_h{size}")
    have, at = size, f"_h{size}"
    while have < width:
        while have + size > width:
            size //= 2
        df = df.withColumn(f"_w{have + size}", join(at, f"_h{size}", have))
        have, at = have + size, f"_w{have + size}"
        made.append(at)
    many = F.greatest(F.col("_n") - (width - 1), F.lit(0))
    return df.withColumn("windows", F.slice(at, F.lit(1), many)).drop("_n", *made)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id (the class's smallest), literal, n_usable, width, at (from 0), h, n_slots and the tokens (own) and values of every usable window."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = items.select(F.col("item_id").cast("long"), text.alias("text")).where("item_id is not null")
    words = plain_tokens(F.col("text"))
    plain = rows.select("item_id", F.lit(True).alias("literal"), words.alias("tokens"), words.alias("values"))
    values = value_tokens(F.col("text"))
    slots = rows.select("item_id", F.lit(False).alias("literal"), template_tokens(F.col("text")).alias("tokens"), values.alias("values"))
    long = plain.unionByName(slots).where(F.size("tokens") >= LEAST_WORDS)
    alike = F.transform("values", lambda v: F.array_position("values", v))  # which values are equal, whatever they are
    classes = long.groupBy("literal", "tokens", F.when(~F.col("literal"), alike).alias("alike")).agg(F.min("item_id").alias("item_id"), F.min_by("values", "item_id").alias("values"))
    classes = classes.withColumn("width", F.least(F.lit(WIDTH), F.size("tokens"))).withColumn("n_windows", F.size("tokens") - F.col("width") + 1)
    at = F.explode(F.sequence(F.lit(1), F.col("n_windows"))).alias("_i")
    rows = classes.select("item_id", "literal", "n_windows", "width", "tokens", "values", at)
    own = rows.select("item_id", "literal", "n_windows", "width", (F.col("_i") - 1).alias("at"), F.expr("slice(tokens, _i, width)").alias("own"), F.expr("slice(values, _i, width)").alias("values"))
    own = own.withColumn("n_slots", F.size(F.filter("own", is_slot))).where(2 * F.col("n_slots") <= F.col("width"))
    hashed = [with_windows(own.where(F.col("width") == w).withColumn("tokens", F.col("own")), w) for w in range(LEAST_WORDS, WIDTH + 1)]
    usable = reduce(DataFrame.unionByName, hashed).withColumn("h", F.col("windows")[0]).drop("windows")
    many = usable.groupBy("item_id", "literal").agg(F.count("*").alias("n_usable"))
    return usable.join(many, ["item_id", "literal"])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))


def _same(a: str, b: str, *names: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])


def short_leaks(rows: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, th and item_id where a whole line is an item of fewer than LEAST_WORDS words."""
    line = lambda c: F.array_join(plain_tokens(c), " ")
    short = items.where("item_id is not null").select(F.col("item_id").cast("long"), plain_tokens(F.col("text").cast("string")).alias("words"))
    short = short.where(F.size("words") < LEAST_WORDS).groupBy(F.array_join("words", " ").alias("line")).agg(F.min("item_id").alias("item_id")).where("line <> ''")
    lines = rows.select(*DOC, F.explode(F.split("text", "\n")).alias("text")).select(*DOC, line(F.col("text")).alias("line")).where("line <> ''")
    return lines.join(short, "line").select(*DOC, "item_id").distinct()


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, th, item_id, literal, coverage, n_slots and agreement of every leaked item of every document.

    ``th`` is a hash of the text: together with the id it names a document.
    """
    bench = common.cut_lineage(spark, benchmark_windows(items))
    common.release(spark)
    sizes = bench.groupBy("literal", "width").agg(F.count("*").alias("n")).collect()
    small = sum(r["n"] for r in sizes) <= BROADCAST_ROWS
    rows = _texts(docs)
    found = []
    for literal in (False, True):
        for w in sorted(r["width"] for r in sizes if r["literal"] == literal):
            tokens = rows.select(*DOC, (plain_tokens if literal else template_tokens)(F.col("text")).alias("tokens"))
            # the outer form, as Spark would else put a filter with a copy of the whole expression in front of the scan
            places = with_windows(tokens, w).select(*DOC, F.lit(literal).alias("literal"), F.lit(w).alias("width"), F.posexplode_outer("windows").alias("pos", "h"))
            keys = bench.where((F.col("literal") == literal) & (F.col("width") == w)).select("h").distinct()
            found.append(places.join(F.broadcast(keys) if small else keys, "h", "left_semi"))
    none = rows.limit(0).select(*DOC, F.lit(True).alias("literal"), F.lit(0).alias("width"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h"))
    places = common.written(spark, reduce(DataFrame.unionByName, found, none), "leak-places")
    common.release(spark)
    key = ["literal", "width", "h"]
    keys = bench.select(*key, "item_id", "at", "n_usable", "n_slots")
    distinct = places.select(*DOC, *key).distinct()
    hits = distinct.join(F.broadcast(keys) if small else keys, key)
    by = [*DOC, "item_id"]
    covered = hits.groupBy(*by, "literal", "n_usable").agg(F.countDistinct("at").alias("n_found"), F.max("n_slots").alias("n_slots"))
    covered = covered.withColumn("coverage", F.col("n_found") / F.col("n_usable")).where(F.col("coverage") >= COVERAGE)
    covered = common.cut_lineage(spark, covered)
    sure = covered.where("literal or n_slots = 0").select(*by, "literal", "coverage", F.lit(0).cast("long").alias("n_slots"), F.lit(1.0).alias("agreement"))
    slotted = covered.where("not literal and n_slots > 0").alias("a").join(covered.where("literal").select(*by).alias("b"), _same("a", "b", *by), "left_anti")
    out = sure.unionByName(consistent(spark, rows, places, bench, slotted))
    if items.where((F.size(plain_tokens(F.col("text").cast("string"))) < LEAST_WORDS) & F.col("item_id").isNotNull()).limit(1).count():
        whole = short_leaks(rows, items).select(*by, F.lit(True).alias("literal"), F.lit(1.0).alias("coverage"), F.lit(0).cast("long").alias("n_slots"), F.lit(1.0).alias("agreement"))
        out = out.unionByName(whole)
    return out


def consistent(spark: SparkSession, rows: DataFrame, places: DataFrame, bench: DataFrame, slotted: DataFrame) -> DataFrame:
    """The covered templates (doc_id, th, item_id, n_usable, coverage) whose slots are consistent, with n_slots and agreement."""
    by = [*DOC, "item_id"]
    slotted = common.cut_lineage(spark, slotted.select(*by, "n_usable", "coverage"))
    some = slotted.select(*DOC).distinct()
    templates = bench.where("not literal").select("item_id", "width", "h", "at", "n_slots", "own", "values")
    own = places.where("not literal").distinct().alias("a").join(slotted.alias("b"), _same("a", "b", *DOC)).select("a.doc_id", "a.th", "a.width", "a.h", "a.pos", "b.item_id", "b.n_usable")
    own = own.join(templates.select("item_id", "width", "h", "at", "n_slots"), ["item_id", "width", "h"])
    own = common.cut_lineage(spark, with_occurrences(own, by))
    share = own.groupBy(*by, "way", "n_usable").agg(F.countDistinct("at").alias("n_found")).select(*by, "way", (F.col("n_found") / F.col("n_usable")).alias("part"))
    texts = rows.alias("a").join(some.alias("b"), _same("a", "b", *DOC), "left_semi").dropDuplicates(DOC).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), value_tokens(F.col("text")).alias("theirs"))
    seen = own.where("n_slots > 0").join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select(*by, "way", "at", F.expr("slice(theirs, pos + 1, width)").alias("theirs"))
    pairs = seen.join(templates.select("item_id", "at", "own", "values"), ["item_id", "at"]).select(*by, "way", F.explode(F.arrays_zip("own", "values", "theirs")).alias("z")).where(is_slot(F.col("z.own")))
    choice = pairs.groupBy(*by, "way", F.col("z.own").alias("kind"), F.col("z.values").alias("ours"), F.col("z.theirs").alias("theirs")).agg(F.count("*").alias("n"))
    agreed = choice.groupBy(*by, "way", "kind", "ours").agg(F.max("n").alias("top"), F.sum("n").alias("n")).groupBy(*by, "way").agg((F.sum("top") / F.sum("n")).alias("agreement"), F.sum("n").alias("seen"))
    ways = share.alias("p").join(agreed.alias("q"), _same("p", "q", *by, "way"), "left").select(*[f"p.{c}" for c in by], "p.way", "p.part", F.coalesce("q.agreement", F.lit(1.0)).alias("agreement"), F.coalesce("q.seen", F.lit(0)).alias("seen"))
    best = ways.groupBy(*by).agg(F.max(F.when(F.col("part") >= COVERAGE, F.col("agreement"))).alias("agreement"), F.max(F.when(F.col("way.kind") == 0, F.col("seen"))).alias("n_slots")).where(F.col("agreement") >= AGREEMENT)
    return slotted.alias("a").join(best.alias("b"), _same("a", "b", *by)).select(*[f"a.{c}" for c in by], F.lit(False).alias("literal"), "a.coverage", "b.n_slots", "b.agreement")


def with_occurrences(places: DataFrame, by: list[str]) -> DataFrame:
    """Each hit under every ``way`` of telling an item's occurrences in a document apart.

    0: all are one. 1: a new one begins where the item's windows stop going forward. 2: hits whose alignments pos - at lie near each other.
    """
    forward, aligned = Window.partitionBy(*by).orderBy("pos", "at"), Window.partitionBy(*by).orderBy("diagonal")
    back = (F.col("at") < F.lag("at").over(forward)) | ((F.col("at") == F.lag("at").over(forward)) & (F.col("pos") > F.lag("pos").over(forward)))
    apart = F.col("diagonal") - F.lag("diagonal").over(aligned) > F.least(F.lit(WIDTH), F.floor((F.col("n_usable") + F.col("width") - 1) / 2))
    marked = places.withColumn("diagonal", F.col("pos") - F.col("at")).withColumn("_back", F.coalesce(back, F.lit(False)).cast("long")).withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("long"))
    marked = marked.withColumn("_run", F.sum("_back").over(forward)).withColumn("_near", F.sum("_apart").over(aligned))
    way = lambda kind, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"))
    ways = F.explode(F.array(way(0, F.lit(0)), way(1, F.col("_run")), way(2, F.col("_near")))).alias("way")
    return marked.select(*by, "n_usable", "pos", "at", "width", "n_slots", ways)


def leaking_documents(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each leaking text of an id: the item of greatest coverage (ties: found as it stands, then smallest id), and how many items leak."""
    best = F.max(F.struct(F.round("coverage", 6).alias("coverage"), "literal", (-F.col("item_id")).alias("i"), "n_slots")).alias("best")
    out = leaks(spark, docs, items).groupBy(*DOC).agg(best, F.countDistinct("item_id").alias("n_items"))
    return out.select(*DOC, (-F.col("best.i")).alias("item_id"), "n_items", "best.coverage", F.col("best.n_slots").alias("n_slots"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak a benchmark item."""
    return leaking_documents(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("th")
