"""Bitmaps over bits (key, off): set bits only, least significant bit of a byte first. A bitmap ends with the byte of its last
set bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import numbering
from cairn.functions.ranges import strict_range


def to_bytes(bits: DataFrame) -> DataFrame:
    """key, byte_no, v: bytes that are not zero."""
    return bits.groupBy("key", F.floor(F.col("off") / 8).alias("byte_no")).agg(F.bit_or(F.expr("shiftleft(1, cast(off % 8 as int))")).cast("int").alias("v"))


def set_bits(log: DataFrame) -> DataFrame:
    """key, off: what a log (seq, key, off, bit) leaves set."""
    return log.groupBy("key", "off").agg(F.max_by("bit", "seq").alias("bit")).where("bit = 1").select("key", "off")


def get_bit(data: DataFrame, req: DataFrame) -> DataFrame:
    """req (key, off) with bit; data are bytes."""
    r = req.withColumn("byte_no", F.floor(F.col("off") / 8))
    return r.join(data, ["key", "byte_no"], "left").select(*req.columns, F.coalesce(F.getbit("v", (F.col("off") % 8).cast("int")).cast("int"), F.lit(0)).alias("bit"))


def count(data: DataFrame) -> DataFrame:
    return data.groupBy("key").agg(F.sum(F.bit_count("v")).cast("long").alias("n"))


def _sized(bits: DataFrame) -> DataFrame:
    return bits.groupBy("key").agg((F.floor(F.max("off") / 8) + 1).alias("n_bytes"))


def count_range(bits: DataFrame, start: int, end: int, unit: str = "BYTE") -> DataFrame:
    """key, n: set bits in an inclusive range of bytes or bits; 0 for a range that leaves the bitmap."""
    scale = 1 if unit == "BIT" else 8
    first, n = strict_range(start, end, F.col("n_bytes") * (8 if unit == "BIT" else 1))
    r = _sized(bits).select("key", (first * scale).alias("a"), ((first + n) * scale).alias("b"))
    return bits.join(r, "key").groupBy("key").agg(F.sum(((F.col("off") >= F.col("a")) & (F.col("off") < F.col("b"))).cast("int")).cast("long").alias("n")).select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def position(bits: DataFrame, bit: int, start: int = 0, end: int = -1, unit: str = "BYTE") -> DataFrame:
    """key, pos: first offset in a range that holds the bit, -1 for none among the stored bytes.

    The first zero is the first place in the sorted run of set bits whose offset runs ahead of its number."""
    scale = 1 if unit == "BIT" else 8
    first, n = strict_range(start, end, F.col("n_bytes") * (8 if unit == "BIT" else 1))
    r = _sized(bits).select("key", (first * scale).alias("a"), ((first + n) * scale).alias("b"))
    inside = bits.join(r, "key").withColumn("in", F.coalesce((F.col("off") >= F.col("a")) & (F.col("off") < F.col("b")), F.lit(False)))
    if bit:
        return inside.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("in"), F.col("off"))), F.lit(-1)).cast("long").alias("pos"))
    held = numbering.numbered(inside.where("in"), ["off"], "nth").groupBy("key").agg(F.min(F.when(F.col("off") > F.col("nth") + F.col("a"), F.col("nth") + F.col("a"))).alias("gap"), F.count(F.lit(1)).alias("n"))
    out = r.join(held, "key", "left").withColumn("z", F.coalesce("gap", F.col("a") + F.coalesce("n", F.lit(0))))
    return out.select("key", F.when(F.col("a").isNotNull() & (F.col("z") < F.col("b")), F.col("z")).otherwise(F.lit(-1)).cast("long").alias("pos"))
