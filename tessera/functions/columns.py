"""Column helpers: defaults, repeated values, recoding, label bases, coordinates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a missing label and a missing coordinate.
MISSING_LABEL, MISSING_COORDINATE = -100, -1.0


def repeated(value: Column | Sequence | int | float, n: int = 3) -> Column:
    """A scalar n times as an array; a sequence as it is."""
    if isinstance(value, (list, tuple)):
        return F.array(*map(F.lit, value))
    return F.array_repeat(value if isinstance(value, Column) else F.lit(value), n)


def set_all(df: DataFrame, names: Sequence[str], value) -> DataFrame:
    """The same literal in several columns."""
    return df.withColumns({n: F.lit(value) for n in names})


def rebased_label(label: str, base: int = 0) -> Column:
    """The label less its base; a missing one is MISSING_LABEL, which is never rebased."""
    return F.coalesce(F.col(label).cast("int") - F.lit(base), F.lit(MISSING_LABEL))


def group_label(group: str) -> Column:
    return F.coalesce(F.col(group).cast("int"), F.lit(MISSING_LABEL))


def coordinates(x: str, y: str) -> Column:
    """A point; both parts must be there, else it is (-1, -1)."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    part = lambda c: F.when(known, F.col(c).cast("float")).otherwise(F.lit(MISSING_COORDINATE).cast("float"))
    return F.struct(part(x).alias("x"), part(y).alias("y"))


def recoded(column: str, names: Mapping) -> Column:
    """Values replaced by names; others stay, as text."""
    if not names:
        return F.col(column).cast("string")
    look = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, str(v))])
    return F.coalesce(look[F.col(column)], F.col(column).cast("string"))


def present_only(spacings: str) -> Column:
    """A map without the entries whose value is null."""
    return F.map_filter(spacings, lambda _, v: v.isNotNull())


def requested_only(data: str, keys: Sequence[str]) -> Column:
    """A map without the keys that nobody asked for."""
    wanted = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    return F.map_filter(data, lambda k, _: F.array_contains(wanted, k))


def natural_key(path: str) -> Column:
    """A sort key under which numbers inside names compare as numbers: digit runs are padded to twenty places."""
    pieces = F.regexp_extract_all(F.lower(F.col(path)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 20, "0")).otherwise(p)), "")
