"""Atomic groups of commands, watched keys, the slow log, command metadata and slot balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.routing import SLOTS, slot

# Name, arity (negative: at least), and which arguments are keys (first, last, step; last -1: to the end).
COMMANDS = {
    "append": (3, 1, 1, 1), "bitcount": (-2, 1, 1, 1), "bitpos": (-3, 1, 1, 1), "copy": (-3, 1, 2, 1), "decr": (2, 1, 1, 1), "decrby": (3, 1, 1, 1), "del": (-2, 1, -1, 1), "exists": (-2, 1, -1, 1), "expire": (3, 1, 1, 1), "expireat": (3, 1, 1, 1),
    "expiretime": (2, 1, 1, 1), "geoadd": (-5, 1, 1, 1), "geodist": (-4, 1, 1, 1), "geohash": (-2, 1, 1, 1), "geopos": (-2, 1, 1, 1), "georadius": (-6, 1, 1, 1), "georadiusbymember": (-5, 1, 1, 1), "get": (2, 1, 1, 1), "getbit": (3, 1, 1, 1), "getdel": (2, 1, 1, 1),
    "getex": (-2, 1, 1, 1), "getrange": (4, 1, 1, 1), "getset": (3, 1, 1, 1), "hdel": (-3, 1, 1, 1), "hexists": (3, 1, 1, 1), "hget": (-3, 1, 1, 1), "hgetall": (2, 1, 1, 1), "hincrby": (4, 1, 1, 1), "hincrbyfloat": (4, 1, 1, 1), "hkeys": (2, 1, 1, 1),
    "hlen": (2, 1, 1, 1), "hmget": (-3, 1, 1, 1), "hmset": (-4, 1, 1, 1), "hrandfield": (-2, 1, 1, 1), "hscan": (-2, 1, 1, 1), "hset": (4, 1, 1, 1), "hsetnx": (4, 1, 1, 1), "hstrlen": (3, 1, 1, 1), "hvals": (2, 1, 1, 1), "incr": (2, 1, 1, 1),
    "incrby": (3, 1, 1, 1), "incrbyfloat": (3, 1, 1, 1), "keys": (2, 0, 0, 0), "lindex": (3, 1, 1, 1), "linsert": (5, 1, 1, 1), "llen": (2, 1, 1, 1), "lpop": (-2, 1, 1, 1), "lpush": (-3, 1, 1, 1), "lpushx": (-3, 1, 1, 1), "lrange": (4, 1, 1, 1),
    "lrem": (4, 1, 1, 1), "lset": (4, 1, 1, 1), "ltrim": (4, 1, 1, 1), "mget": (-2, 1, -1, 1), "mset": (-3, 1, -1, 2), "msetnx": (-3, 1, -1, 2), "persist": (2, 1, 1, 1), "pexpire": (3, 1, 1, 1), "pexpireat": (3, 1, 1, 1), "pexpiretime": (2, 1, 1, 1),
    "psetex": (4, 1, 1, 1), "pttl": (2, 1, 1, 1), "randomkey": (1, 0, 0, 0), "rename": (3, 1, 2, 1), "renamenx": (3, 1, 2, 1), "rpop": (-2, 1, 1, 1), "rpoplpush": (3, 1, 2, 1), "rpush": (-3, 1, 1, 1), "rpushx": (-3, 1, 1, 1), "sadd": (-3, 1, 1, 1),
    "scan": (-2, 0, 0, 0), "scard": (2, 1, 1, 1), "sdiff": (-2, 1, -1, 1), "sdiffstore": (-3, 1, -1, 1), "set": (-3, 1, 1, 1), "setbit": (4, 1, 1, 1), "setex": (4, 1, 1, 1), "setnx": (3, 1, 1, 1), "setrange": (4, 1, 1, 1), "sinter": (-2, 1, -1, 1),
    "sinterstore": (-3, 1, -1, 1), "sismember": (3, 1, 1, 1), "smembers": (2, 1, 1, 1), "spop": (-2, 1, 1, 1), "srandmember": (-2, 1, 1, 1), "srem": (-3, 1, 1, 1), "sscan": (-2, 1, 1, 1), "strlen": (2, 1, 1, 1), "sunion": (-2, 1, -1, 1), "sunionstore": (-3, 1, -1, 1),
    "ttl": (2, 1, 1, 1), "type": (2, 1, 1, 1), "zadd": (-4, 1, 1, 1), "zcard": (2, 1, 1, 1), "zcount": (4, 1, 1, 1), "zincrby": (4, 1, 1, 1), "zlexcount": (4, 1, 1, 1), "zpopmin": (-2, 1, 1, 1), "zrange": (-4, 1, 1, 1), "zrangebylex": (-4, 1, 1, 1),
    "zrangebyscore": (-4, 1, 1, 1), "zrank": (3, 1, 1, 1), "zrem": (-3, 1, 1, 1), "zremrangebylex": (4, 1, 1, 1), "zremrangebyrank": (4, 1, 1, 1), "zremrangebyscore": (4, 1, 1, 1), "zrevrange": (-4, 1, 1, 1), "zrevrangebylex": (-4, 1, 1, 1), "zrevrangebyscore": (-4, 1, 1, 1), "zrevrank": (3, 1, 1, 1),
    "zscan": (-2, 1, 1, 1), "zscore": (3, 1, 1, 1),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """name, arity, first_key, last_key, step."""
    return spark.createDataFrame([(n, *v) for n, v in COMMANDS.items()], "name string, arity int, first_key int, last_key int, step int")


def validated(commands: DataFrame, spark: SparkSession) -> DataFrame:
    """commands (cmd, args with the name not among them) with status: ok, unknown command, or wrong number of arguments."""
    c = commands.join(F.broadcast(catalogue(spark)), F.col("cmd") == F.col("name"), "left")  # about a hundred rows
    words = F.size("args") + 1
    fits = F.when(F.col("arity") >= 0, words == F.col("arity")).otherwise(words >= -F.col("arity"))
    return c.withColumn("status", F.when(F.col("name").isNull(), "unknown command").when(~fits, "wrong number of arguments").otherwise("ok")).select(*commands.columns, "status")


def get_keys(commands: DataFrame, spark: SparkSession) -> DataFrame:
    """commands with keys: the arguments that name keys."""
    c = commands.join(F.broadcast(catalogue(spark)), F.col("cmd") == F.col("name"))
    last = F.when(F.col("last_key") < 0, F.size("args") + 1 + F.col("last_key")).otherwise(F.col("last_key"))
    at = F.when(F.col("first_key") > 0, F.sequence("first_key", last, "step")).otherwise(F.array().cast("array<int>"))
    return c.select(*commands.columns, F.transform(at, lambda i: F.get("args", i - 1)).alias("keys"))


def atomic(commands: DataFrame, failed: Column) -> DataFrame:
    """The commands of transactions none of whose commands failed."""
    bad = commands.where(failed).select("txn").distinct()
    return commands.join(bad, "txn", "left_anti")


def without_conflicts(transactions: DataFrame, watches: DataFrame, commands: DataFrame) -> DataFrame:
    """Transactions (txn, ...) whose watched keys (txn, key, seen_at, run_at) have the same version when they run as when they were
    seen, by a log of commands (key, seq)."""
    asks = watches.select("txn", "key", F.explode(F.array("seen_at", "run_at")).alias("at"))
    seen = versions_at(commands, asks.select("key", "at").distinct())
    now = watches.join(seen.withColumnsRenamed({"at": "seen_at", "version": "version"}), ["key", "seen_at"]).join(seen.withColumnsRenamed({"at": "run_at", "version": "now"}), ["key", "run_at"])
    return transactions.join(now.where(F.col("now") != F.col("version")).select("txn").distinct(), "txn", "left_anti")


#: Commands are counted in spans of so many sequence numbers before they are ordered.
SPAN = 4096


def versions_at(commands: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (key, at, ...) with version: the commands on the key before `at`. Whole spans of sequence numbers are counted within
    tasks and summed a row a span; only within a span are commands ordered, so a key with most of the log is spread over spans."""
    span = lambda c: F.floor(F.col(c) / SPAN).cast("long")
    per = commands.groupBy("key", span("seq").alias("span")).agg(F.count(F.lit(1)).alias("n"))
    wanted = asks.select("key", span("at").alias("span")).distinct().withColumn("n", F.lit(0).cast("long"))
    spans = per.unionByName(wanted).groupBy("key", "span").agg(F.sum("n").alias("n"))
    before = spans.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("span")) - F.col("n")).select("key", "span", "before")
    places = asks.select("key", "at").distinct().select("key", F.col("at").alias("seq"), F.lit(0).cast("long").alias("one"))
    both = commands.select("key", "seq", F.lit(1).cast("long").alias("one")).unionByName(places).withColumn("span", span("seq"))
    order = Window.partitionBy("key", "span").orderBy("seq", "one").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("within", F.sum("one").over(order)).where("one = 0").select("key", F.col("seq").alias("at"), "span", "within")
    found = within.join(before, ["key", "span"]).select("key", "at", (F.col("before") + F.col("within")).alias("version"))
    return asks.join(found, ["key", "at"])


def slow_log(executions: DataFrame, at_least: float, n: int) -> DataFrame:
    """The newest n executions (id, duration) that took long enough."""
    return executions.where(F.col("duration") >= at_least).orderBy(F.desc("id")).limit(n)


def slot_histogram(keys: DataFrame) -> DataFrame:
    """slot, n."""
    return keys.groupBy(slot(F.col("key")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def rebalance(histogram: DataFrame, nodes: int) -> DataFrame:
    """slot, n, node, target: the node that a slot is on when slots are dealt in turn, and where it goes so that each node's share
    of keys is even: slots in order of number, cut at equal sums (one row a slot, at most 1,024)."""
    total = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(total.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.least(F.floor(before * nodes / F.sum("n").over(total)), F.lit(nodes - 1))
    return histogram.select("slot", "n", F.floor(F.col("slot") * nodes / SLOTS).alias("node"), share.alias("target"))
