"""Streams: counters with expiry kept in state, and delivery of published messages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; where the session names none, a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return f"{root.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into a new shared folder and read back: what comes before runs once, however often df is used."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Counters(StatefulProcessor):
    """One counter a key from rows (key, seq, delta, expire_at_ms). The expiry of the row with the largest seq that sets one holds:
    it takes the place of an earlier one, whose timer is deleted. When the timer fires, the counter is gone and the next row starts
    from 0. Emits key, seq, value after each batch, value null on expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counter", StructType().add("seq", LongType()).add("value", LongType()).add("expire_at_ms", LongType()).add("set_by", LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, value, armed, set_by = self.state.get() if self.state.exists() else (-1, 0, None, -1)
        expiry = armed
        for pdf in rows:
            value += int(pdf.delta.sum())
            seq = max(seq, int(pdf.seq.max()))
            setting = pdf[pdf.expire_at_ms.notna()]
            if len(setting) and int(setting.seq.max()) > set_by:
                last = setting.loc[setting.seq.idxmax()]
                expiry, set_by = int(last.expire_at_ms), int(last.seq)
        if expiry != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(expiry)
        self.state.update((seq, value, expiry, set_by))
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "value": [value]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        seq, _, expiry, _ = self.state.get()
        if expiry is None or expiry > expiredTimerInfo.getExpiryTimeInMs():  # a later expiry holds
            return
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "value": pd.array([None], dtype="Int64")})

    def close(self) -> None:
        pass


_OUT = StructType().add("key", StringType()).add("seq", LongType()).add("value", LongType())


def counters(stream: DataFrame, expiring: bool = False) -> DataFrame:
    """key, seq, value updates of a stream (key, seq, delta, expire_at_ms)."""
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=Counters(), outputStructType=_OUT, outputMode="Update", timeMode="ProcessingTime" if expiring else "None")


def fold_available(spark: SparkSession, folder: str, schema: StructType, steps, pattern: str = "*.parquet") -> DataFrame:
    """key, value after all Parquet files of a folder, or those that match pattern, have passed through the stream once. steps
    makes (key, seq, delta, expire_at_ms) of them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = shared_folder(spark, "updates")
    updates = counters(steps(spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)))
    query = updates.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", shared_folder(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{out}/batch=*").groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def fan_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """messages (channel, ...) once for each client of their channel; messages may be a stream. Subscribing twice counts once."""
    return messages.join(subscriptions.select("channel", "client").distinct(), "channel")


def subscribe(subscriptions: DataFrame, new: DataFrame) -> DataFrame:
    return subscriptions.unionByName(new).dropDuplicates(["channel", "client"])


def unsubscribe(subscriptions: DataFrame, gone: DataFrame) -> DataFrame:
    """gone has channel and client; a null channel leaves all of the client's."""
    some = gone.where(F.col("channel").isNotNull()).select("channel", "client")
    every = gone.where(F.col("channel").isNull()).select("client")
    return subscriptions.join(some, ["channel", "client"], "left_anti").join(every, "client", "left_anti")


def live_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, channel) by window, late ones up to a bound; beyond the survey's operators, for dashboards of streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "channel").agg(F.count(F.lit(1)).alias("n"))
