"""Column functions on labels, names and sample positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode(name: Column, table: dict[str, str]) -> Column:
    """Exact-match recoding; what has no entry stays."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), name), name)


def group_of(column: str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    found = F.regexp_extract(column, pattern, group)
    return F.when(found != "", found)


def file_core(column: str, prefix: str = "") -> Column:
    """A file name without `prefix` and the blanks after it, each character that file systems forbid as an underscore.

    A name that is nothing but the prefix stays.
    """
    name = F.col(column)
    if prefix:
        cut = F.ltrim(F.substring(name, len(prefix) + 1, 1 << 20))
        name = F.when(name.startswith(prefix) & (cut != ""), cut).otherwise(name)
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def to_sample(column: str, rate: float, plus: int = 0, rounded: bool = False) -> Column:
    """Seconds to a sample index, cut towards zero, or rounded with halves away from zero."""
    place = F.col(column) * F.lit(float(rate))
    return ((F.round(place) if rounded else place) + plus).cast("long")


def half_even(column: str | Column, digits: int) -> Column:
    """Rounding to even halves."""
    return F.bround(column, digits)


def conv_length(n: Column, kernel: int, stride: int = 1, dilation: int = 1, padding: str = "valid") -> Column:
    """Output length of a convolution."""
    size = kernel + (kernel - 1) * (dilation - 1)
    out = n if padding in ("same", "causal") else n - size + 1
    return F.floor((out + stride - 1) / stride)


def power_of_two_floor(n: Column) -> Column:
    """The largest power of two not above n."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("long")


def odd_width(frames: Column, most: int = 9, least: int = 3) -> Column:
    """The widest odd filter width that fits into the frames, null below `least`."""
    width = F.least(F.lit(most), frames - (1 - frames % 2))
    return F.when(width >= least, width)


def is_power_of_two(n: Column) -> Column:
    """Whether a positive number has one set bit."""
    return (n > 0) & (F.bit_count(n) == 1)
