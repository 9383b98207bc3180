"""Numbers, running sums and former values within keys of any size: no task holds a whole key.

Where a key's order begins with an integer, its rows are dealt into spans of SPAN integers. Windows run within a span, and one row a
key and span says what the spans before it hold. Any other order is dealt by ranges. Rows without a key, or whose
integer is null, get null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 65_536


def _span(at: Column) -> Column:
    return F.floor(at / SPAN).cast("long")


def _known(value: Column) -> Column:
    return F.when(F.col("key").isNotNull() & F.col("span").isNotNull(), value)


def with_totals(rows: DataFrame, on: list[str], **totals: Column) -> DataFrame:
    """rows with aggregates over all rows of the same `on`: aggregated within tasks first and joined."""
    return rows.join(rows.groupBy(*on).agg(*[c.alias(name) for name, c in totals.items()]), on, "left")


def running(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount over its key's rows up to each. order begins with an integer column."""
    dealt = rows.withColumn("span", _span(F.col(order[0]))).withColumn("amount", amount)
    up_to = Window.partitionBy("key", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.where("span is not null").groupBy("key", "span").agg(F.sum("amount").alias("amount")).select("key", "span", F.sum("amount").over(earlier).alias("before"))
    both = dealt.withColumn("within", F.sum("amount").over(up_to)).join(before, ["key", "span"], "left")
    return both.select(*rows.columns, _known(F.coalesce(F.col("within") + F.col("before"), "within", "before")).alias(name))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number from 0 within their key. order begins with an integer column."""
    counted = running(rows, order, F.lit(1).cast("long"), name)
    return counted.withColumn(name, F.col(name) - 1)


def former(rows: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """rows with the value of the row before, in the order of the integer `at`."""
    dealt = rows.withColumn("span", _span(F.col(at)))
    near = Window.partitionBy("key", "span").orderBy(at)
    last = dealt.where("span is not null").groupBy("key", "span").agg(F.max_by(value, at).alias("last"))
    before = last.select("key", "span", F.lag("last").over(Window.partitionBy("key").orderBy("span")).alias("before"))
    both = dealt.withColumn("first", F.row_number().over(near) == 1).withColumn("within", F.lag(value).over(near)).join(before, ["key", "span"], "left")
    return both.select(*rows.columns, _known(F.when(F.col("first"), F.col("before")).otherwise(F.col("within"))).alias(name))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number from 0 within their key, in any order: sorted by ranges over all tasks, numbered within each, and
    shifted by what the tasks before hold of the key (one row a task and key)."""
    spread = rows.repartitionByRange(F.col("key"), *order).withColumn("task", F.spark_partition_id())
    # ranges are sampled, and both readers must see the same ones
    spread = spread.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else spread.persist()
    earlier = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.groupBy("key", "task").agg(F.count(F.lit(1)).alias("n")).select("key", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("key", "task").orderBy(*order))
    return spread.withColumn("nth", nth).join(before, ["key", "task"], "left").select(*rows.columns, (F.col("before") + F.col("nth") - 1).cast("long").alias(name))
