"""Set operators over sets (key, member), members of a key distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.patterns import glob


def add(sets: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets after new, and how many members each key gained."""
    fresh = new.select("key", "member").distinct().join(sets, ["key", "member"], "left_anti")
    return sets.select("key", "member").unionByName(fresh), fresh.groupBy("key").agg(F.count(F.lit(1)).alias("added"))


def is_member(sets: DataFrame, req: DataFrame) -> DataFrame:
    return req.join(sets.select("key", "member", F.lit(1).alias("found")), ["key", "member"], "left").select(*req.columns, F.coalesce("found", F.lit(0)).alias("found"))


def remove(sets: DataFrame, req: DataFrame) -> DataFrame:
    return sets.join(req.select("key", "member"), ["key", "member"], "left_anti")


def cardinality(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def members(sets: DataFrame, key: str) -> DataFrame:
    return sets.where(F.col("key") == key).select("member")


def intersect(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Members that all keys have: one shuffle however many keys there are, counted before it."""
    keys = list(dict.fromkeys(keys))
    return sets.where(F.col("key").isin(keys)).groupBy("member").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(keys)).select("member")


def union(sets: DataFrame, keys: list[str]) -> DataFrame:
    return sets.where(F.col("key").isin(keys)).select("member").distinct()


def subtract(sets: DataFrame, first: str, *rest: str) -> DataFrame:
    """Members of first that no other has: one shuffle."""
    mine = F.max((F.col("key") == first).cast("int")).alias("mine")
    others = F.max(F.col("key").isin(list(rest)).cast("int")).alias("others") if rest else F.lit(0).alias("others")
    if first in rest:
        return sets.where(F.lit(False)).select("member")
    return sets.where(F.col("key").isin([first, *rest])).groupBy("member").agg(mine, others).where("mine = 1 and others = 0").select("member")


def store(sets: DataFrame, key: str, result: DataFrame) -> DataFrame:
    """The sets with result at key; an empty result leaves no key."""
    return sets.where(F.col("key") != key).unionByName(result.select(F.lit(key).alias("key"), "member"))


def scan(sets: DataFrame, pattern: str) -> DataFrame:
    return sets.where(glob(F.col("member"), pattern))
