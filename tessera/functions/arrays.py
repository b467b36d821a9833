"""Images as nested arrays of numbers: what built-in functions can express without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rows_of(flat: Column, width: int) -> Column:
    """A flat array as rows of ``width`` values."""
    many = F.floor(F.size(flat) / F.lit(width)).cast("int")
    return F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(flat, i * width + 1, width))


def cropped(rows: Column, height: int, width: int) -> Column:
    """The central height x width part; of an odd difference the extra row or column is cut at the end."""
    top = F.floor((F.size(rows) - height) / F.lit(2)).cast("int") + 1
    left = lambda r: F.floor((F.size(r) - width) / F.lit(2)).cast("int") + 1
    return F.transform(F.slice(rows, top, height), lambda r: F.slice(r, left(r), width))


def padded(rows: Column, size: int, value: float) -> Column:
    """Constant padding at the lower and right edge up to size x size."""
    filled = F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(value), size)), 1, size))
    blank = F.array_repeat(F.array_repeat(F.lit(value), size), size)
    return F.slice(F.concat(filled, blank), 1, size)


def flipped(rows: Column, horizontal: bool) -> Column:
    return F.transform(rows, F.reverse) if horizontal else F.reverse(rows)


def transposed(rows: Column) -> Column:
    width = F.size(F.get(rows, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def rotated(rows: Column, quarters: int) -> Column:
    """Counter-clockwise quarter turns."""
    for _ in range(quarters % 4):
        rows = F.reverse(transposed(rows))
    return rows


def replaced(pixels: Column, old: list[int], new: list[int]) -> Column:
    """Pixels (arrays of channel values) equal to ``old`` become ``new``."""
    before, after = F.array(*map(F.lit, old)), F.array(*map(F.lit, new))
    return F.transform(pixels, lambda p: F.when(p == before, after).otherwise(p))


def scaled(values: Column, largest: float = 255.0) -> Column:
    """Integers of a byte as fractions of ``largest``."""
    return F.transform(values, lambda v: v.cast("double") / F.lit(largest))


def with_channel(rows: Column) -> Column:
    """A mask of two axes gets a third one of length one."""
    return F.transform(rows, lambda r: F.transform(r, lambda v: F.array(v)))


def channels_last(planes: Column) -> Column:
    """channel x height x width to height x width x channel."""
    first = F.get(planes, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.transform(F.sequence(F.lit(0), F.size(F.get(first, F.lit(0))) - 1), lambda j: F.transform(planes, lambda p: F.get(F.get(p, i), j))))
