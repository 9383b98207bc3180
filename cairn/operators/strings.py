"""String and counter operators over strings (key, value) and write logs (seq, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import numbering
from cairn.functions.numbers import strict_int
from cairn.functions.ranges import strict_range


def get(strings: DataFrame, req: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """req with value and status: ok, missing, or wrongtype where another collection has the key."""
    found = req.join(strings.select("key", "value"), "key", "left")
    if types is None:
        return found.withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("ok"))
    found = found.join(types.where("type <> 'string'").select("key", F.lit(True).alias("other")), "key", "left")
    return found.withColumn("status", F.when(F.col("value").isNotNull(), "ok").when(F.col("other"), "wrongtype").otherwise("missing")).drop("other")


def last_write(log: DataFrame) -> DataFrame:
    """key, value: what a series of plain writes leaves."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def first_write(log: DataFrame) -> DataFrame:
    """key, value: what a series of writes leaves that only write absent keys."""
    return log.groupBy("key").agg(F.min_by("value", "seq").alias("value"))


def set_(strings: DataFrame, new: DataFrame) -> DataFrame:
    """new has one row a key."""
    return strings.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "value"))


def set_expiring(strings: DataFrame, new: DataFrame, as_of_ms: int, unit_ms: int = 1000) -> DataFrame:
    """strings (key, value, expire_at_ms) after writes that live for a time: new has (pos, key, value, ttl), ttl in units of unit_ms
    (1000: seconds, 1: ms). The last write of a key wins; a ttl of 0 or less is refused and changes nothing."""
    good = new.where(F.col("ttl") > 0)
    last = good.groupBy("key").agg(F.max_by(F.struct("value", "ttl"), "pos").alias("w"))
    made = last.select("key", F.col("w.value").alias("value"), (F.lit(as_of_ms) + F.col("w.ttl") * unit_ms).cast("long").alias("expire_at_ms"))
    return strings.join(made.select("key"), "key", "left_anti").select("key", "value", "expire_at_ms").unionByName(made)


def get_expiring(strings: DataFrame, req: DataFrame, as_of_ms: int) -> DataFrame:
    """req with the value and the expiry from then on: req has (key, option, n), option EX, PX (n from now), EXAT, PXAT (n as it
    is), PERSIST or null (unchanged). A missing or expired key has neither."""
    held = strings.where(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") >= as_of_ms)).select("key", "value", F.col("expire_at_ms").alias("was"), F.lit(True).alias("there"))
    option, n = F.upper("option"), F.col("n")
    at = (
        F.when(option == "EX", F.lit(as_of_ms) + n * 1000).when(option == "PX", F.lit(as_of_ms) + n).when(option == "EXAT", n * 1000).when(option == "PXAT", n)
        .when(option == "PERSIST", F.lit(None).cast("long")).otherwise(F.col("was"))
    )
    return req.join(held, "key", "left").select(*req.columns, "value", F.when(F.col("there"), at).cast("long").alias("expire_at_ms"))


def set_nx(strings: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that are written: those whose key is free."""
    return new.join(strings.select("key"), "key", "left_anti")


def set_xx(strings: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(strings.select("key"), "key", "left_semi")


def mset(strings: DataFrame, new: DataFrame) -> DataFrame:
    """new has (pos, key, value): the last value of a repeated key wins."""
    return set_(strings, new.groupBy("key").agg(F.max_by("value", "pos").alias("value")))


def mset_nx(strings: DataFrame, new: DataFrame) -> DataFrame:
    """All of new, or nothing where any of its keys exists. new: txn, key, value; each txn is one call, calls don't share keys."""
    taken = new.join(strings.select("key"), "key", "left_semi").select("txn").distinct()
    return new.join(taken, "txn", "left_anti")


def get_set(log: DataFrame) -> DataFrame:
    """The former value that each write of a log replies."""
    return numbering.former(log, "seq", "value", "former")


def get_del(strings: DataFrame, req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of the requested keys, and the strings without them."""
    return get(strings, req), strings.join(req.select("key"), "key", "left_anti")


def strlen(strings: DataFrame, req: DataFrame) -> DataFrame:
    """Bytes, 0 for a missing key."""
    return req.join(strings, "key", "left").select(*req.columns, F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("n"))


def get_range(strings: DataFrame, start, end) -> DataFrame:
    """key, part: bytes of an inclusive range, null where it leaves the value. A part that cuts a character holds just its bytes."""
    first, n = strict_range(start, end, F.octet_length("value"))
    return strings.select("key", F.expr("cast(value as binary)").alias("b"), first.cast("int").alias("first"), n.cast("int").alias("n")).select("key", F.when(F.col("first").isNotNull(), F.substring("b", F.col("first") + 1, F.col("n")).cast("string")).alias("part"))


def set_range(strings: DataFrame, offset: int, text: str) -> DataFrame:
    """key, value overwritten from a byte on, the gap filled with zero bytes. Characters that are cut leave their other bytes."""
    old = F.col("value").cast("binary")
    n = F.octet_length("value")
    head = F.substring(old, F.lit(1), F.lit(offset))
    gap = F.repeat(F.lit("\0"), F.greatest(F.lit(offset) - n, F.lit(0))).cast("binary")
    put = F.lit(text).cast("binary")
    tail = F.substring(old, F.lit(offset) + F.octet_length(put) + 1, n)
    return strings.select("key", F.concat(head, gap, put, tail).cast("string").alias("value"))


def append(log: DataFrame) -> DataFrame:
    """key, value, n: pieces (seq, key, value) joined in order, and the bytes."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "")
    return log.groupBy("key").agg(joined.alias("value")).withColumn("n", F.octet_length("value").cast("long"))


def incr_running(log: DataFrame, delta: Column) -> DataFrame:
    """log with the counter after each step."""
    kept = [c for c in log.columns if c != "value"]
    return numbering.running(log.withColumn("delta", delta), ["seq"], F.col("delta"), "after").select(*kept, F.col("after").alias("value"))


def incr_total(log: DataFrame, delta: Column) -> DataFrame:
    """key, value: counters at the end. A sum beyond 64 bits is null."""
    return log.groupBy("key").agg(F.try_sum(delta).alias("value"))


def incr_by(strings: DataFrame, deltas: DataFrame) -> DataFrame:
    """key, value, status of one step on stored texts: deltas (key, delta); a missing key counts from 0."""
    found = deltas.join(strings, "key", "left")
    old = F.when(F.col("value").isNull(), F.lit(0).cast("long")).otherwise(strict_int(F.col("value")))
    new = F.try_add(old, F.col("delta"))
    return found.select("key", new.alias("value"), F.when(old.isNull(), "not an integer").when(new.isNull(), "overflow").otherwise("ok").alias("status"))
