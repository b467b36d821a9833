"""Small document tables for the operators' tests."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside themselves.
CLASH = ("h", "fp", "th", "row", "word", "tokens", "spans", "removed", "kept", "score", "_score", "component_id", "ids", "host", "path", "rule")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def docs(spark, texts, first=0, lang="en"):
    rows = [(first + i, t, lang, f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def prose(rng, n, vocabulary=400):
    """n invented words in sentences."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))
