"""Hash operators over hashes (key, field, val) and logs (seq, key, field, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.patterns import glob


def get(hashes: DataFrame, req: DataFrame) -> DataFrame:
    """req (key, field) with val, null where there is none."""
    return req.join(hashes, ["key", "field"], "left").select(*req.columns, "val")


def get_many(hashes: DataFrame, fields: list[str]) -> DataFrame:
    """One row a key, one column a field. The filter on fields reaches the relation before the pivot."""
    return hashes.where(F.col("field").isin(fields)).groupBy("key").pivot("field", fields).agg(F.first("val"))


def exists(hashes: DataFrame, req: DataFrame) -> DataFrame:
    return req.join(hashes.select("key", "field", F.lit(1).alias("found")), ["key", "field"], "left").select(*req.columns, F.coalesce("found", F.lit(0)).alias("found"))


def length(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def field_length(hashes: DataFrame, req: DataFrame) -> DataFrame:
    """Bytes of a field, 0 if missing."""
    return get(hashes, req).select(*req.columns, F.coalesce(F.octet_length("val"), F.lit(0)).cast("long").alias("n"))


def fields(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "field")


def values(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "val")


def set_log(log: DataFrame) -> DataFrame:
    """key, field, val: what a log of sets leaves."""
    return log.groupBy("key", "field").agg(F.max_by("val", "seq").alias("val"))


def set_nx_log(log: DataFrame) -> DataFrame:
    return log.groupBy("key", "field").agg(F.min_by("val", "seq").alias("val"))


def set_many(hashes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hashes after new (key, field, val), and for each new field whether it was absent."""
    kept = hashes.join(new.select("key", "field"), ["key", "field"], "left_anti")
    added = new.join(hashes.select("key", "field", F.lit(0).alias("added")), ["key", "field"], "left").select("key", "field", F.coalesce("added", F.lit(1)).alias("added"))
    return kept.unionByName(new.select("key", "field", "val")), added


def delete(hashes: DataFrame, req: DataFrame) -> DataFrame:
    return hashes.join(req.select("key", "field"), ["key", "field"], "left_anti")


def incr(log: DataFrame, delta: Column) -> DataFrame:
    """key, field, total of a log of additions; an integer sum beyond 64 bits is null."""
    return log.groupBy("key", "field").agg(F.try_sum(delta).alias("total"))


def scan(hashes: DataFrame, pattern: str) -> DataFrame:
    return hashes.where(glob(F.col("field"), pattern))
