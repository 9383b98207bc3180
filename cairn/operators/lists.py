"""List operators over lists (key, pos, val): positions count from 0 without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import numbering
from cairn.functions.ranges import clamped_range


def sized(lists: DataFrame) -> DataFrame:
    """lists with the length of each: counted within tasks first and joined, so a long list is not gathered in one task."""
    return lists.join(lists.groupBy("key").agg(F.count(F.lit(1)).alias("len")), "key")


def renumbered(rows: DataFrame) -> DataFrame:
    """key, pos, val with the gaps between positions closed."""
    return numbering.numbered(rows, ["pos"], "to").select("key", F.col("to").alias("pos"), "val")


def _shifted(lists: DataFrame, few: DataFrame, pos: Column) -> DataFrame:
    """lists with new positions, from columns of few (one row a key, not of every key)."""
    return lists.join(few, "key", "left").select("key", pos.cast("long").alias("pos"), "val")


def length(lists: DataFrame, req: DataFrame) -> DataFrame:
    n = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return req.join(n, "key", "left").select(*req.columns, F.coalesce("n", F.lit(0)).alias("n"))


def index(lists: DataFrame, i: int) -> DataFrame:
    """key, val at a position, counted from the tail if negative; no row where it is out of range."""
    if i >= 0:
        return lists.where(F.col("pos") == i).select("key", "val")
    return sized(lists).where(F.col("pos") == F.col("len") + i).select("key", "val")


def between(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """The rows of an inclusive range. Ranges that count from the head only need no length."""
    if start >= 0 and stop >= 0:
        return lists.where(F.col("pos").between(start, stop))
    a, b = clamped_range(start, stop, F.col("len"))
    return sized(lists).where((F.col("pos") >= a) & (F.col("pos") < b)).drop("len")


def trim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """The lists cut to a range; what is left empty is gone."""
    if start >= 0:
        return between(lists, start, stop).select("key", (F.col("pos") - start).alias("pos"), "val")
    a, b = clamped_range(start, stop, F.col("len"))
    return sized(lists).where((F.col("pos") >= a) & (F.col("pos") < b)).select("key", (F.col("pos") - a).alias("pos"), "val")


def pop_left(lists: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """The first n of each list, and what is left."""
    if n < 0:
        raise ValueError("count must not be negative")
    return lists.where(F.col("pos") < n), lists.where(F.col("pos") >= n).withColumn("pos", F.col("pos") - n)


def pop_right(lists: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """The last n of each list (nth counts from the tail), and what is left."""
    if n < 0:
        raise ValueError("count must not be negative")
    rows = sized(lists)
    return rows.where(F.col("pos") >= F.col("len") - n).withColumn("nth", F.col("len") - 1 - F.col("pos")).drop("len"), rows.where(F.col("pos") < F.col("len") - n).drop("len")


def _pushed(lists: DataFrame, new: DataFrame, only_existing: bool) -> DataFrame:
    """key, nth, val of new, nth from 0 without gaps."""
    if only_existing:
        new = new.join(lists.select("key").distinct(), "key", "left_semi")
    return numbering.numbered(new.select("key", "nth", "val"), ["nth"], "to").select("key", F.col("to").alias("nth"), "val")


def push_right(lists: DataFrame, new: DataFrame, only_existing: bool = False) -> DataFrame:
    """new (key, nth, val) behind each list, in order of nth. The elements that were there are not moved."""
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("len"))
    return lists.select("key", "pos", "val").unionByName(_shifted(_pushed(lists, new, only_existing), sizes, F.coalesce("len", F.lit(0)) + F.col("nth")))


def push_left(lists: DataFrame, new: DataFrame, only_existing: bool = False) -> DataFrame:
    """new before each list: the last pushed comes first. The elements that were there move by the number of new ones."""
    new = _pushed(lists, new, only_existing)
    sizes = new.groupBy("key").agg(F.count(F.lit(1)).alias("len"))
    return _shifted(lists, sizes, F.col("pos") + F.coalesce("len", F.lit(0))).unionByName(_shifted(new, sizes, F.col("len") - 1 - F.col("nth")))


def move_tail_to_head(lists: DataFrame, moves: DataFrame) -> DataFrame:
    """The last element of src becomes the first of dst (src, dst: each key in one move at most)."""
    last, _ = pop_right(lists, 1)
    taken = last.select(F.col("key").alias("src"), "pos", "val").join(moves, "src")
    rest = lists.join(taken.select(F.col("src").alias("key"), "pos"), ["key", "pos"], "left_anti")
    return push_left(rest, taken.select(F.col("dst").alias("key"), F.lit(0).alias("nth"), "val"))


def remove(lists: DataFrame, count: int, val: str) -> DataFrame:
    """Without all (0), the first n or the last -n elements equal to val."""
    same = lists.where(F.col("val") == val).select("key", "pos")
    if count:
        pos = F.col("pos").asc() if count > 0 else F.col("pos").desc()
        nth = F.row_number().over(Window.partitionBy("key").orderBy(pos))  # each task sends a key's first n alone
        same = same.withColumn("nth", nth).where(F.col("nth") <= abs(count)).drop("nth")
    kept = lists.join(same, ["key", "pos"], "left_anti") if count else lists.where(~F.col("val").eqNullSafe(val))
    return renumbered(kept)


def replace(lists: DataFrame, i: int, val: str) -> DataFrame:
    """val at a position; lists that have no such position stay."""
    at = F.col("pos") == (F.lit(i) if i >= 0 else F.col("len") + i)
    return (lists if i >= 0 else sized(lists)).select("key", "pos", F.when(at, F.lit(val)).otherwise(F.col("val")).alias("val"))


def insert(lists: DataFrame, pivot: str, val: str, after: bool = False) -> DataFrame:
    """val next to the first pivot of each list; lists without it stay."""
    first = lists.where(F.col("val") == pivot).groupBy("key").agg((F.min("pos") + int(after)).alias("at"))
    moved = _shifted(lists, first, F.col("pos") + F.coalesce((F.col("pos") >= F.col("at")).cast("int"), F.lit(0)))
    return moved.unionByName(first.select("key", F.col("at").alias("pos"), F.lit(val).alias("val")))
