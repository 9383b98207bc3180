"""Random members of collections: uniform, and the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import numbering


def lot(seed: int, *parts: str) -> Column:
    """A text that orders rows at random: the MD5 of the seed and the row, which any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]).cast("binary"))


def sample(rows: DataFrame, what: str, n: int, seed: int) -> DataFrame:
    """n > 0: up to n distinct rows of each key; n < 0: -n rows of each key, with repetition; 0: none."""
    if n >= 0:
        order = Window.partitionBy("key").orderBy(lot(seed, "key", what), what)  # each task sends a key's first n alone
        return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")
    numbered = numbering.ranked(rows, [F.col(what)], "i").withColumn("i", F.col("i") + 1)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    draws = sizes.select("key", "m", F.explode(F.sequence(F.lit(1), F.lit(-n))).alias("draw")).select("key", "draw", (F.pmod(F.conv(F.substring(lot(seed, "key", "draw"), 1, 13), 16, 10).cast("long"), "m") + 1).alias("i"))
    return draws.join(numbered, ["key", "i"]).drop("i")


def pop(rows: DataFrame, what: str, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """n random rows of each key, and the rest. The choice is a function of the seed, so a replay removes the same."""
    if n <= 0:
        raise ValueError("ERR value is out of range, must be positive")
    taken = sample(rows, what, n, seed)
    return taken, rows.join(taken.select("key", what), ["key", what], "left_anti")
