"""Mixing sources to target weights.

Words per source are summed over the whole table, each source gets a target share by its weight, and a document of a source
with repetition rate r = target / size is emitted floor(r) times plus once more with probability r - floor(r). That coin is
a hash of the seed and the document's id, so a rerun, a retry or another partitioning emits the same copies.

Defined cases
    null source      a source of its own, last in the order of sources
    null text        size 0; sizes of 0 take nothing, whatever their rate
    null doc_id      the coin is seeded by the text instead
    repeated rows    each row flips the coin of its id, so equal rows fare alike
    empty table      no sources, no rows
    extra columns    kept; the added columns start with two underscores
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import workspace as ws

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at this multiple of its source's size.
CAP = 3
SEED = "cairn-mix-1"
#: Up to so many sources, their table of four numbers each is broadcast (about 8 MB); beyond, Spark picks the join.
BROADCAST_SOURCES = 100_000


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, rate of a frame with source and size.

    Filling by level: with c = cap * size / weight in ascending order, a source is capped while its c lies below the level
    (total - what the capped before it take) / (weight of it and all after it). The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy("c", F.col("source").asc_nulls_last())
    return (
        per.withColumn("w", picked.cast("long"))
        .withColumn("c", (cap * F.col("source_size")).cast("double") / F.col("w"))
        .withColumn("before", F.coalesce(F.sum(cap * F.col("source_size")).over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("w").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("here", (F.col("total") - F.col("before")).cast("double") / F.col("rest"))
        .withColumn("fill", F.max(F.when(F.col("here") <= F.col("c"), F.col("here"))).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least((cap * F.col("source_size")).cast("double"), F.coalesce(F.col("fill") * F.col("w"), (cap * F.col("source_size")).cast("double"))))
        .select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)).alias("rate"))
    )


def plan_copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with __size, __source_size, __target, __rate and __copies. One pass sums the sources, a second marks the rows."""
    sized = docs.select("source", ws.n_words(F.col("text")).alias("size"))
    targets, _ = ws.stage(source_targets(sized, weights, cap), "mix-sources")
    targets = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    coin = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
    whole = F.floor("__rate")
    return (
        docs.withColumn("__size", ws.n_words(F.col("text")))
        .join(targets, F.col("source").eqNullSafe(F.col("__source")), "left")
        .drop("__source")
        .withColumn("__copies", (whole + (coin < F.col("__rate") - whole).cast("long")).cast("long"))
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: every document as often as it is taken, in the columns of docs."""
    return plan_copies(docs, **how).withColumn("__copy", F.explode(F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies").cast("int"))).otherwise(F.array().cast("array<int>")))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return plan_copies(ws.table(spark, sf_dir, "documents")).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w FROM s),
c AS (SELECT *, CAST({CAP} * source_size AS DOUBLE) / w AS c FROM w),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum({CAP} * source_size) OVER (
           ORDER BY c, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(w) OVER (ORDER BY c, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS here
  FROM c),
f AS (SELECT *, max(CASE WHEN here <= c THEN here END) OVER () AS fill FROM l),
t AS (SELECT source, source_size, least(CAST({CAP} * source_size AS DOUBLE), coalesce(fill * w, {CAP} * source_size)) AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least({CAP}.0, target / source_size) ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
       d.size * CAST(floor(r.rate) + CASE WHEN CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, '')))), 1, 13) AS BIGINT)
                / CAST({16**13} AS DOUBLE) < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
