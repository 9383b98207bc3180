"""Index ranges with negative positions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def strict_range(start, end, size) -> tuple[Column, Column]:
    """First index and number of items of an inclusive range; both null where it leaves the collection: a start or an end before
    the first item, a start behind the last one, or a start behind the end. An end behind the last item is the last item."""
    start, end, size = _col(start), _col(end), _col(size)
    first = F.when(start < 0, size + start).otherwise(start)
    last = F.when(end < 0, size + end + 1).otherwise(F.least(end + 1, size))
    ok = (start >= -size) & (start < size) & (end >= -size) & (first <= last)
    return F.when(ok, first), F.when(ok, last - first)


def clamped_range(start, stop, size) -> tuple[Column, Column]:
    """First index and one behind the last of an inclusive range, cut to the collection: never null, empty where nothing is left."""
    start, stop, size = _col(start), _col(stop), _col(size)
    first = F.when(start < -size, F.lit(0)).when(start < 0, size + start).otherwise(F.least(start, size))
    last = F.when(stop < -size, F.lit(0)).when(stop < 0, size + stop + 1).otherwise(F.least(stop + 1, size))
    return first, F.greatest(first, last)
