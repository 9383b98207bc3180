"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as Parquet in the
shared folder and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import minhash, mixing, packing, quality, tokens, toxicity
from cairn.llm import workspace as ws


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.keep_clean(docs, ws.table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram likelihood ratio."""
    return quality.keep_good(docs, ws.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place in it. Executors come here with the heap and the workers of four stages, so
    workers remember no more pieces than a single task would; what they forget they merge again."""
    return packing.pack(docs, memory=tokens.REMEMBERED_BYTES).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", clean), ("quality rules", good), ("near-duplicates", distinct), ("mixing", mixed), ("packing", sequences)]

#: Trees, hashed n-grams and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ws.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs, _ = ws.stage(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
