"""Shared scratch space, staged tables and the few helpers that every operator needs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, as all operators here read it.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of rows that a Python worker is given at a time in small_batches.
BATCH_BYTES = 4 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a local one in local mode only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{checkpoint_root(spark)}/cairn-{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder and returns it read back, with its path: lineage ends there, and an
    executor's loss costs nothing that was staged."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand their rows to Python by BATCH_BYTES, and a row. By itself Spark hands over 10,000 rows at a time, of
    whole texts tens of MB, which the JVM and the worker then hold side by side. A limit that the session sets itself stands."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(limit, None) is not None
    if not own:
        spark.conf.set(limit, str(BATCH_BYTES))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(limit)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, flag: Column) -> DataFrame:
    """Rows whose flag is true. A plain filter would be pushed down through the projections that flag comes from, and their shared
    steps computed anew wherever the filter mentions them; what a generator makes stays above them, so they are computed once."""
    return df.withColumn("__only", F.explode(F.array(flag))).where("__only").drop("__only")


def n_words(text: Column) -> Column:
    """Words of a text (null: 0): what is left when each word shrinks to one letter and the gaps go."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), GAP, "")).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows of the evaluation fold: crc32 of the id as text leaves 1 modulo 3. Null ids are never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
