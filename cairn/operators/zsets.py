"""Sorted-set operators over zsets (key, member, score): the order is (score, member by bytes)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import numbering
from cairn.functions.patterns import glob
from cairn.functions.ranges import clamped_range


def _of_key():
    return Window.partitionBy("key")


def _order(reverse: bool = False):
    return _of_key().orderBy(F.desc("score"), F.desc("member")) if reverse else _of_key().orderBy("score", "member")


def add_log(log: DataFrame) -> DataFrame:
    """key, member, score left by a log (seq, key, member, score); scores that are no number are not taken."""
    return log.where(~F.isnan("score")).groupBy("key", "member").agg(F.max_by("score", "seq").alias("score"))


def score(zsets: DataFrame, req: DataFrame) -> DataFrame:
    return req.join(zsets, ["key", "member"], "left").select(*req.columns, "score")


def incr(log: DataFrame) -> DataFrame:
    """key, member, score: sums of a log (key, member, delta)."""
    return log.groupBy("key", "member").agg(F.sum("delta").alias("score"))


def ranked(zsets: DataFrame, reverse: bool = False) -> DataFrame:
    """zsets with rank from 0."""
    return numbering.ranked(zsets, [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")], "rank")


def rank(zsets: DataFrame, req: DataFrame, reverse: bool = False) -> DataFrame:
    """req (key, member) with rank; only requested keys are sorted."""
    asked = zsets.join(req.select("key").distinct(), "key", "left_semi")
    return req.join(ranked(asked, reverse).select("key", "member", "rank"), ["key", "member"], "left").select(*req.columns, "rank")


def cardinality(zsets: DataFrame) -> DataFrame:
    return zsets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def border(text: str) -> tuple[float, bool]:
    """Value and openness of a score border: `(5` is open, `-inf` and `+inf` have no end."""
    is_open = text.startswith("(")
    value = float(text[1:] if is_open else text)
    if math.isnan(value):
        raise ValueError("ERR min or max is not a float")
    return value, is_open


def _scores(low: str, high: str) -> Column:
    (a, a_open), (b, b_open) = border(low), border(high)
    s = F.col("score")
    out = F.lit(True)
    if a != -math.inf or a_open:
        out = out & (s > a if a_open else s >= a)
    if b != math.inf or b_open:
        out = out & (s < b if b_open else s <= b)
    return out


def _lexes(low: str, high: str) -> Column:
    """`[x` with, `(x` without x, `-` and `+` the ends."""
    out, m = F.lit(True), F.col("member")
    for text, sign, ends in ((low, 1, "-+"), (high, -1, "+-")):
        if text == ends[0]:
            continue
        if text == ends[1]:
            return F.lit(False)
        if text[:1] not in ("[", "("):
            raise ValueError("ERR min or max not valid string range item")
        v = F.lit(text[1:])
        out = out & ((m >= v if sign > 0 else m <= v) if text[0] == "[" else (m > v if sign > 0 else m < v))
    return out


def count(zsets: DataFrame, low: str, high: str) -> DataFrame:
    """key, n within a score interval, 0 for keys without any."""
    return zsets.groupBy("key").agg(F.count_if(_scores(low, high)).alias("n"))


def lex_count(zsets: DataFrame, low: str, high: str) -> DataFrame:
    return zsets.groupBy("key").agg(F.count_if(_lexes(low, high)).alias("n"))


def by_rank(zsets: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """zsets with rank, of an inclusive range of ranks. Ranges that begin and end near one end filter the row number itself, so each
    task keeps only what can still win before the shuffle; only ranges from head to tail number all."""
    size = F.col("n")
    if start >= 0 and stop >= 0:
        rows = zsets.withColumn("r", F.row_number().over(_order(reverse))).where(F.col("r") <= stop + 1)
        return rows.where(F.col("r") > start).select(*zsets.columns, (F.col("r") - 1).cast("long").alias("rank"))
    if start < 0 and stop < 0:  # from the tail: the head of the other direction
        return by_rank(zsets, -stop - 1, -start - 1, not reverse).join(cardinality(zsets), "key").select(*zsets.columns, (size - 1 - F.col("rank")).alias("rank"))
    rows = by_rank(zsets, 0, stop, reverse) if start < 0 else ranked(zsets, reverse)
    a, b = clamped_range(start, stop, size)
    return rows.join(cardinality(zsets), "key").where((F.col("rank") >= a) & (F.col("rank") < b)).select(*zsets.columns, "rank")


def _limited(rows: DataFrame, order, columns: list[str], offset: int, limit: int) -> DataFrame:
    if offset < 0:
        return rows.where(F.lit(False)).select(*columns)
    if offset == 0 and limit < 0:
        return rows.select(*columns)
    rows = rows.withColumn("r", F.row_number().over(order))
    if limit >= 0:
        rows = rows.where(F.col("r") <= offset + limit)
    return rows.where(F.col("r") > offset).select(*columns)


def by_score(zsets: DataFrame, low: str, high: str, offset: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
    """Members of a score interval, each key's own offset and limit; a negative limit takes all."""
    return _limited(zsets.where(_scores(low, high)), _order(reverse), zsets.columns, offset, limit)


def by_lex(zsets: DataFrame, low: str, high: str, offset: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
    order = _of_key().orderBy(F.desc("member") if reverse else F.asc("member"))
    return _limited(zsets.where(_lexes(low, high)), order, zsets.columns, offset, limit)


def pop_min(zsets: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """The n lowest of each key, and the rest."""
    taken = by_rank(zsets, 0, n - 1).drop("rank") if n > 0 else zsets.where(F.lit(False))
    return taken, remove(zsets, taken)


def remove(zsets: DataFrame, req: DataFrame) -> DataFrame:
    return zsets.join(req.select("key", "member"), ["key", "member"], "left_anti")


def remove_by_score(zsets: DataFrame, low: str, high: str) -> DataFrame:
    return zsets.where(~_scores(low, high))


def remove_by_lex(zsets: DataFrame, low: str, high: str) -> DataFrame:
    return zsets.where(~_lexes(low, high))


def remove_by_rank(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    return remove(zsets, by_rank(zsets, start, stop))


def scan(zsets: DataFrame, pattern: str) -> DataFrame:
    """Matching members; scores as text with ten decimals."""
    return zsets.where(glob(F.col("member"), pattern)).withColumn("score_text", F.format_string("%.10f", "score"))
