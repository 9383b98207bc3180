"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and punctuation runs of a text, and pairs of neighbours, are hashed to a fixed number of buckets. Two multinomials over
those buckets, one from all documents that `labels` calls good and one from all documents, give each bucket a weight
log(p_target / p_raw); a document's score is the mean weight of its n-grams, and it is kept at or above a fixed threshold.
All of it is DataFrame expressions: no Python runs on the executors. The weight table has a fixed size (BUCKETS numbers), so it
goes to the driver and into the plan as one array.

Defined cases
    null or empty text   no words: every count 0, base_failed, not kept, score 0
    repeated rows        judged row by row, each alike
    null labels, ids     such labels are skipped; several labels of an id must all be 1 for the id to be trusted
    no trusted document  every weight is 0, so the base rules alone decide
    empty table          no rows
    extra columns        kept by `score`; the added columns start with two underscores
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import workspace as ws

BUCKETS = 1 << 16
#: A document is kept from this mean weight up (nats per n-gram).
MIN_SCORE = -0.5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Weights are integers in millionths: their sums don't depend on the order of addition.
UNIT = 1_000_000

_TOKENS = r"[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+"


def base_columns(docs: DataFrame) -> DataFrame:
    """docs with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words and __base_failed.

    A 5-word window is held as one 64-bit hash. Only texts in which a window occurs twice sort their windows by (hash, place);
    the places of repeated windows then cover 5 words each, less what the next one covers.
    """
    return (
        docs.withColumn("__text", F.coalesce("text", F.lit("")))
        .withColumn("__words", F.expr(rf"array_remove(split(__text, '[\\x20\\x09-\\x0D]+'), '')"))
        .withColumn("__lines", F.expr(r"filter(split(__text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
        .withColumn("__h", F.expr("transform(__words, w -> xxhash64(w))"))
        .withColumn("__n_words", F.expr("cast(size(__words) as bigint)"))
        .withColumn("__word_chars", F.expr(r"cast(length(regexp_replace(__text, '[\\x20\\x09-\\x0D]+', '')) as bigint)"))
        .withColumn("__n_symbols", F.expr(r"cast(length(regexp_replace(__text, '[^#*$%&|<>]+', '')) as bigint)"))
        .withColumn("__n_dup_lines", F.expr("cast(size(__lines) - size(array_distinct(__lines)) as bigint)"))
        .withColumn("__win", F.expr("if(size(__h) < 5, cast(array() as array<bigint>), transform(sequence(0, greatest(size(__h) - 5, 0)), i -> xxhash64(get(__h, i), get(__h, i + 1), get(__h, i + 2), get(__h, i + 3), get(__h, i + 4))))"))
        .drop("__words", "__lines", "__h")
        .withColumn("__sorted", F.expr("case when size(array_distinct(__win)) < size(__win) then sort_array(transform(__win, (x, i) -> named_struct('x', x, 'i', i))) end"))
        .withColumn("__at", F.expr("array_sort(filter(transform(__sorted, (s, k) -> if(s.x <=> get(__sorted, k - 1).x or s.x <=> get(__sorted, k + 1).x, s.i, -1)), i -> i >= 0))"))
        .withColumn("__n_repeat_words", F.expr("coalesce(aggregate(transform(__at, (i, k) -> least(5, coalesce(get(__at, k + 1) - i, 5))), 0L, (a, x) -> a + x), 0L)"))
        .drop("__text", "__win", "__sorted", "__at")
        .withColumn("__base_failed", (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEATED_PERCENT * F.col("__n_words")))
    )


def _codes(text: str) -> str:
    """One 16-bit number for each token: a 65536th of all hashes."""
    return f"transform(regexp_extract_all(coalesce({text}, ''), '{_TOKENS}', 0), t -> cast(pmod(xxhash64(t), {BUCKETS}L) - 32768 as smallint))"


def _grams(codes: str) -> str:
    """Buckets of the tokens and of the pairs of neighbours, those of pairs made from the tokens' codes."""
    return (
        f"concat(transform({codes}, c -> cast(c as int) + 32768), "
        f"zip_with({codes}, slice({codes}, 2, greatest(size({codes}), 1)), (a, b) -> if(b is null, cast(null as int), cast(pmod(xxhash64(a, b), {BUCKETS}L) as int))))"
    )


def coded(docs: DataFrame) -> DataFrame:
    """doc_id and the codes of the text: the least that has to move where documents meet their labels."""
    return docs.select("doc_id", F.expr(_codes("text")).alias("t"))


def bucket_counts(codes: DataFrame) -> DataFrame:
    """bucket, n over all n-grams: summed within tasks first, so at most BUCKETS rows leave each task."""
    return codes.select(F.explode(F.expr(_grams("t"))).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def bucket_weights(docs: DataFrame, labels: DataFrame) -> list[int]:
    """log(p_target / p_raw) of every bucket in millionths, counts raised by one."""
    raw = bucket_counts(coded(docs)).withColumn("of", F.lit("raw"))
    good = bucket_counts(coded(docs).join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi")).withColumn("of", F.lit("good"))
    rows = raw.unionByName(good).groupBy("bucket").pivot("of", ["raw", "good"]).agg(F.sum("n")).na.fill(0).collect()  # at most BUCKETS rows
    n_raw, n_good = sum(r["raw"] for r in rows), sum(r["good"] for r in rows)
    weights = [0] * BUCKETS
    if n_good:
        for r in rows:
            weights[r["bucket"]] = round(UNIT * (math.log((r["good"] + 1) / (n_good + BUCKETS)) - math.log((r["raw"] + 1) / (n_raw + BUCKETS))))
    return weights


def score(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs with the base columns, __score and __kept."""
    table = ",".join(map(str, bucket_weights(docs, labels)))
    weights = F.split(F.lit(table), ",").cast("array<bigint>")
    total = F.aggregate(F.col("__g"), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(F.get(weights, b), F.lit(0)))
    grams = F.greatest(F.lit(1), 2 * F.size("__t") - 1)
    return (
        base_columns(docs)
        .withColumn("__t", F.expr(_codes("text")))
        .withColumn("__g", F.expr(_grams("__t")))
        .withColumn("__score", total / grams / F.lit(float(UNIT)))
        .drop("__t", "__g")
        .withColumn("__kept", ~F.col("__base_failed") & (F.col("__score") >= min_score))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return ws.only(score(docs, labels), F.col("__kept")).select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return score(ws.table(spark, sf_dir, "documents"), ws.table(spark, sf_dir, "labels")).select("doc_id", *[F.col(f"__{n}").alias(n) for n in names])
