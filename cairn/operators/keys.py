"""Key-space operators over keys (key, type, expire_at_ms, version). Time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.patterns import glob
from cairn.operators.sampling import lot

BUCKETS = 1024


def live(keys: DataFrame, as_of_ms: int) -> DataFrame:
    """Keys that have not expired: a key still lives at the very instant of its expiry."""
    return keys.where(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") >= as_of_ms))


def dealt(relation: DataFrame) -> DataFrame:
    """The relation over all shuffle partitions by key. Adaptive execution merges small partitions to about one a core, whose share
    grows with the input; it leaves a number that was asked for, and with it the join's other side."""
    return relation.repartition(int(relation.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def _asked(req: DataFrame) -> DataFrame:
    """key, __asked: what is joined where a semi or anti join would be pushed into every part of a union of relations, each of which
    would sort all requests for itself in the same tasks."""
    return req.select("key").distinct().withColumn("__asked", F.lit(True))


def delete(relation: DataFrame, req: DataFrame) -> DataFrame:
    """What is left of any relation with a key."""
    return dealt(relation).join(_asked(req), "key", "left").where("__asked is null").select(*relation.columns)


def deleted_count(keys: DataFrame, req: DataFrame) -> DataFrame:
    return dealt(keys.select("key")).join(_asked(req), "key").agg(F.count(F.lit(1)).alias("n"))


def exists_count(keys: DataFrame, req: DataFrame, as_of_ms: int) -> DataFrame:
    """How many requested keys exist; one that is asked for twice counts twice."""
    return req.join(live(keys, as_of_ms), "key").agg(F.count(F.lit(1)).alias("n"))


def exist_in(keys: DataFrame, req: DataFrame, as_of_ms: int) -> DataFrame:
    return req.join(live(keys, as_of_ms), "key", "left_semi")


def type_of(keys: DataFrame, req: DataFrame, as_of_ms: int) -> DataFrame:
    return req.join(live(keys, as_of_ms).select("key", "type"), "key", "left").withColumn("type", F.coalesce("type", F.lit("none")))


def match(keys: DataFrame, pattern: str, as_of_ms: int) -> DataFrame:
    return live(keys, as_of_ms).where(glob(F.col("key"), pattern)).select("key")


def scan_page(keys: DataFrame, as_of_ms: int, after: tuple[int, str] | None, count: int, pattern: str = "*", kind: str | None = None) -> DataFrame:
    """The next `count` keys in (bucket, key) order behind `after`: over a full cycle each stable key comes up once. The last row
    of a page is the next cursor."""
    found = live(keys, as_of_ms).where(glob(F.col("key"), pattern))
    if kind:
        found = found.where(F.col("type") == kind)
    found = found.select(F.pmod(F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int").alias("bucket"), "key")
    if after:
        found = found.where((F.col("bucket") > after[0]) | ((F.col("bucket") == after[0]) & (F.col("key") > after[1])))
    return found.orderBy("bucket", "key").limit(count)


def rename(keys: DataFrame, moves: DataFrame) -> DataFrame:
    """keys after moves (src, dst): the entity and its expiry move, whatever stood at dst goes. src = dst changes nothing; a
    missing src leaves dst alone. Of several moves to one dst, the one whose src comes first wins."""
    real = _one_to_each(moves).where("src <> dst").join(keys.select(F.col("key").alias("src")), "src", "left_semi")
    kept = delete(keys, real.select(F.col("dst").alias("key")).unionByName(real.select(F.col("src").alias("key"))))
    moved = keys.join(real.select(F.col("src").alias("key"), "dst"), "key").drop("key").withColumnRenamed("dst", "key").select(*keys.columns)
    return kept.unionByName(moved)


def _one_to_each(moves: DataFrame) -> DataFrame:
    return moves.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")


def rename_nx(keys: DataFrame, moves: DataFrame, as_of_ms: int) -> DataFrame:
    """rename, only for moves whose dst doesn't live."""
    return rename(keys, moves.join(live(keys, as_of_ms).select(F.col("key").alias("dst")), "dst", "left_anti"))


def copy(keys: DataFrame, moves: DataFrame, replace: bool = False) -> DataFrame:
    """keys with copies at dst; without replace, only where dst is free."""
    moves = _one_to_each(moves)
    free = moves if replace else moves.join(keys.select(F.col("key").alias("dst")), "dst", "left_anti")
    real = free.where("src <> dst").join(keys.select(F.col("key").alias("src")), "src", "left_semi")
    made = keys.join(real.select(F.col("src").alias("key"), "dst"), "key").drop("key").withColumnRenamed("dst", "key").select(*keys.columns)
    return delete(keys, real.select(F.col("dst").alias("key"))).unionByName(made)


def expire(keys: DataFrame, at: Column) -> DataFrame:
    """Sets the expiry, in ms of the epoch: now + seconds * 1000, seconds * 1000, now + ms, or ms, as the command has it."""
    return keys.withColumn("expire_at_ms", at.cast("long"))


def persist(keys: DataFrame) -> DataFrame:
    """reply is 1 where there was an expiry."""
    return keys.withColumn("reply", F.col("expire_at_ms").isNotNull().cast("int")).withColumn("expire_at_ms", F.lit(None).cast("long"))


def _times(keys: DataFrame, req: DataFrame, as_of_ms: int, value: Column, name: str) -> DataFrame:
    found = req.join(live(keys, as_of_ms).select("key", "expire_at_ms", F.lit(True).alias("there")), "key", "left")
    out = F.when(F.col("there").isNull(), F.lit(-2)).when(F.col("expire_at_ms").isNull(), F.lit(-1)).otherwise(value)
    return found.select(*req.columns, out.cast("long").alias(name))


def ttl(keys: DataFrame, req: DataFrame, as_of_ms: int) -> DataFrame:
    """Seconds left, half a second rounded up; -1 without expiry, -2 without key."""
    return _times(keys, req, as_of_ms, F.round((F.col("expire_at_ms") - as_of_ms) / 1000), "ttl")


def pttl(keys: DataFrame, req: DataFrame, as_of_ms: int) -> DataFrame:
    return _times(keys, req, as_of_ms, F.col("expire_at_ms") - as_of_ms, "pttl")


def expire_time(keys: DataFrame, req: DataFrame, as_of_ms: int) -> DataFrame:
    return _times(keys, req, as_of_ms, F.floor(F.col("expire_at_ms") / 1000), "expire_time")


def pexpire_time(keys: DataFrame, req: DataFrame, as_of_ms: int) -> DataFrame:
    return _times(keys, req, as_of_ms, F.col("expire_at_ms"), "pexpire_time")


def info(keys: DataFrame, as_of_ms: int) -> DataFrame:
    """keys, expires and the mean time left of those that expire, for each type."""
    left = (F.col("expire_at_ms") - as_of_ms).cast("double")
    return live(keys, as_of_ms).groupBy("type").agg(F.count(F.lit(1)).alias("keys"), F.count("expire_at_ms").alias("expires"), F.avg(left).alias("avg_ttl_ms"))


def size(keys: DataFrame) -> DataFrame:
    """Keys that are held, expired ones that nobody has asked for since included."""
    return keys.agg(F.count(F.lit(1)).alias("n"))


def in_database(relation: DataFrame, n: int) -> DataFrame:
    """What a session sees after selecting database n: relation has a column db."""
    return relation.where(F.col("db") == n).drop("db")


def copy_between(keys: DataFrame, moves: DataFrame, replace: bool = False) -> DataFrame:
    """keys (db, key, ...) with copies at (dst_db, dst) of (src_db, src); without replace, only where the destination is free. Of
    several moves to one destination, the one whose source comes first wins."""
    real = moves.where((F.col("src") != F.col("dst")) | (F.col("src_db") != F.col("dst_db")))
    real = real.groupBy("dst_db", "dst").agg(F.min(F.struct("src_db", "src")).alias("s")).select("dst_db", "dst", "s.src_db", "s.src")
    if not replace:
        real = real.join(keys.select(F.col("db").alias("dst_db"), F.col("key").alias("dst")), ["dst_db", "dst"], "left_anti")
    source = keys.withColumnsRenamed({"db": "src_db", "key": "src"})
    made = source.join(real, ["src_db", "src"]).withColumnsRenamed({"dst_db": "db", "dst": "key"}).select(*keys.columns)
    return keys.join(made.select("db", "key"), ["db", "key"], "left_anti").unionByName(made)


def random_key(keys: DataFrame, as_of_ms: int, seed: int, n: int = 1) -> DataFrame:
    return live(keys, as_of_ms).select("key").orderBy(lot(seed, "key"), "key").limit(n)


def versions(commands: DataFrame) -> DataFrame:
    """key, version: writes so far."""
    return commands.groupBy("key").agg(F.count(F.lit(1)).alias("version"))


def dump(relation: DataFrame, order: str) -> DataFrame:
    """key, dump: a key's rows as JSON, in order."""
    rest = [c for c in relation.columns if c != "key"]
    return relation.groupBy("key").agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in rest if c != order])))).alias("dump"))


def flush(commands: DataFrame, flushes: DataFrame) -> DataFrame:
    """The commands that a flush (seq) has not undone."""
    last = flushes.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    return commands.join(F.broadcast(last), F.col("seq") > F.col("last")).drop("last")  # one row
