"""The star-schema tables seen as a key space: one long relation for each collection type."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import numbering

#: 2024-01-16 00:00 UTC: the instant at which expiry is judged.
AS_OF_MS = 1_705_363_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def epoch_ms():
    """ts as ms, half a millisecond rounded up."""
    return F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + 500) / 1000)


@dataclass(frozen=True)
class KeySpace:
    """Relations of one database. A relation is read only by the operators that use it."""

    spark: SparkSession
    sf_dir: str

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def strings(self) -> DataFrame:
        """key, value"""
        return self._t("part").select(key("part:", "p_partkey").alias("key"), F.col("p_name").alias("value"))

    def lists(self) -> DataFrame:
        """key, pos (from 0), val"""
        rows = self._t("events").select(key("user:", "user_id").alias("key"), "event_id", F.col("event_type").alias("val"))
        return numbering.numbered(rows, ["event_id"], "pos").select("key", "pos", "val")

    def hashes(self) -> DataFrame:
        """key, field, val"""
        fields = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
        c = self._t("customer").select(key("customer:", "c_custkey").alias("key"), *[F.col(f).cast("string").alias(f) for f in fields])
        return c.unpivot("key", fields, "field", "val")

    def sets(self) -> DataFrame:
        """key, member"""
        return self._t("orders").select(key("prio:", "o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("member")).distinct()

    def zsets(self) -> DataFrame:
        """key, member, score"""
        return self._t("customer").select(key("nation:", "c_nationkey").alias("key"), F.col("c_custkey").cast("string").alias("member"), F.col("c_acctbal").alias("score"))

    def lex(self) -> DataFrame:
        """key, member, score: all scores 0"""
        return self._t("part").select(key("brand:", "p_brand").alias("key"), F.col("p_name").alias("member"), F.lit(0.0).alias("score")).distinct()

    def bits(self) -> DataFrame:
        """key, off: the bits that are set"""
        e = self._t("events")
        return e.select(F.concat(F.lit("act:"), "event_type", F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("key"), F.col("user_id").alias("off")).distinct()

    def points(self) -> DataFrame:
        """key, member, lng, lat"""
        c = F.col("c_custkey")
        return self._t("customer").select(F.lit("geo:cust").alias("key"), c.cast("string").alias("member"), (((c * 7919) % 360000) / 1000 - 180).alias("lng"), (((c * 104729) % 160000) / 1000 - 80).alias("lat"))

    def keys(self) -> DataFrame:
        """key, type, expire_at_ms, version: strings without expiry, and one expiring key for each event"""
        e = self._t("events").select(key("evt:", "event_id").alias("key"), F.lit("string").alias("type"), (epoch_ms() + (F.col("user_id") % 48) * 3_600_000).alias("expire_at_ms"), F.lit(1).cast("long").alias("version"))
        return e.unionByName(self.typed_keys().select("key", "type", F.lit(None).cast("long").alias("expire_at_ms"), F.lit(1).cast("long").alias("version")))

    def typed_keys(self) -> DataFrame:
        """key, type of the collections, from the columns that name them"""
        named = (("string", "part", "part:", "p_partkey"), ("list", "events", "user:", "user_id"), ("hash", "customer", "customer:", "c_custkey"), ("set", "orders", "prio:", "o_orderpriority"), ("zset", "customer", "nation:", "c_nationkey"))
        some = [self._t(name).select(key(prefix, column).alias("key")).distinct().select("key", F.lit(kind).alias("type")) for kind, name, prefix, column in named]
        return reduce(DataFrame.unionByName, some)

    def events(self) -> DataFrame:
        return self._t("events")

    def commands(self) -> DataFrame:
        """seq, txn, ts, cmd, key, arg1, arg2: the event stream as write commands"""
        kind, user = F.col("event_type"), F.col("user_id").cast("string")
        to = lambda c, v, s, h, d: F.when(kind == "click", c).when(kind == "view", v).when(kind == "purchase", s).when(kind == "signup", h).otherwise(d)
        return self._t("events").select(
            F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 5).alias("txn"), "ts",
            to(*map(F.lit, ("incr", "rpush", "zincrby", "hset", "sadd"))).alias("cmd"),
            to(F.concat(F.lit("cnt:"), user), F.concat(F.lit("views:"), user), F.lit("spend"), F.concat(F.lit("user:"), user), F.lit("errors")).alias("key"),
            to(F.lit("1"), F.col("props"), user, F.lit("ts"), user).alias("arg1"),
            to(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("value").cast("string"), F.col("event_id").cast("string"), F.lit(None).cast("string")).alias("arg2"),
        )
