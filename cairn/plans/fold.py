"""State of a key space from its command log.

Commands fall into classes: the last writer wins (set, hset, zadd, expire), the first writer wins (setnx, hsetnx), sums (incr,
hincrby, zincrby), membership (sadd, srem, hdel, zrem), and those whose order matters within a key (list edits, append, popping).
The first four are aggregates that Spark combines before it shuffles; only keys with a command of the last class are replayed,
each by itself, in Python. A delete or flush makes everything before it void, which is one filter against the last of them.

A log is (seq, cmd, key, args array<string>), seq unique. The folds read the commands of COVERED; `settled` first tells commands of
several keys (mset, msetnx, del, rename, renamenx, copy) and setex, psetex by commands of one key that the folds read. Any other one,
such as rpoplpush and the stores of set algebra, which write what another key holds then, or spop, which picks at random, raises.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import numbering
from cairn.functions.numbers import float_text, strict_int
from cairn.streaming.live import shared_folder

RESETS = ("del", "getdel")
FLUSHES = ("flushdb", "flushall")
STRINGS = ("set", "setnx", "getset", "incr", "decr", "incrby", "decrby")
ZSETS = ("zadd", "zincrby", "zrem")
#: Commands that only a replay in order can answer.
LISTS_ORDERED = ("lpush", "lpop", "rpop", "lrem", "lset", "linsert", "ltrim")
STRINGS_ORDERED = ("append", "setrange")
ZSETS_ORDERED = ("zpopmin", "zremrangebyrank", "zremrangebyscore", "zremrangebylex")
ORDERED = LISTS_ORDERED + STRINGS_ORDERED
COVERED = (*RESETS, *FLUSHES, *STRINGS, *ORDERED, "rpush", "hset", "hmset", "hsetnx", "hincrby", "hdel", "sadd", "srem", *ZSETS, *ZSETS_ORDERED, "pexpireat", "persist")
MOVES = ("rename", "renamenx", "copy")
#: Parts that a key's rows are dealt to where they meet the keys to be replayed.
PARTS = 16


def covered(log: DataFrame) -> DataFrame:
    """The log; a command that no fold reads raises."""
    unknown = F.raise_error(F.concat(F.lit("no fold for the command "), F.coalesce("cmd", F.lit("null")))).cast("string")
    return log.withColumn("cmd", F.when(F.col("cmd").isin(*COVERED), F.col("cmd")).otherwise(unknown))


def _split(rows: DataFrame, commands: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """rows of keys without any of commands, and rows of keys with some. A large key is dealt to PARTS tasks."""
    parts = F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))
    keys = rows.where(F.col("cmd").isin(*commands)).select("key").distinct().select("key", F.explode(parts).alias("part"))
    dealt = rows.withColumn("part", F.pmod(F.col("seq").cast("long"), F.lit(PARTS).cast("long")))
    return dealt.join(keys, ["key", "part"], "left_anti").drop("part"), dealt.join(keys, ["key", "part"], "left_semi").drop("part")


def settled(log: DataFrame) -> DataFrame:
    """The log without commands of several keys. As in a server's log, every command in it took effect: the source of a move was
    there, the keys of msetnx and the destination of renamenx were not.

    A move starts a new stretch of its destination's history, a rename one of its source's too. What a key holds in the end is what
    was written in its last stretch and in those that it came from, so their rows are told under that key's name. There are as many
    joins as the longest chain of moves into one key has links; the rows themselves are joined once. Stretches are numbered in spans
    (`numbering`), so no task holds a whole key. The time of setex and psetex is left out: the pexpireat that follows them in a log
    says it. copy to another database raises."""
    log = log.select("seq", "cmd", "key", "args")
    none = F.array().cast("array<string>")
    words = F.concat(F.array("key"), F.coalesce("args", none))
    of = lambda *names: F.coalesce(F.col("cmd").isin(*names), F.lit(False))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 2).cast("int") - 1), lambda i: F.struct(F.get(words, 2 * i).alias("key"), F.get(words, 2 * i + 1).alias("val")))
    many = log.where(of("mset", "msetnx") & (F.size("args") > 0)).select("seq", F.posexplode(pairs).alias("nth", "p")).groupBy("seq", F.col("p.key").alias("key")).agg(F.max_by("p.val", "nth").alias("val"))
    told = reduce(DataFrame.unionByName, [
        log.where(~of("mset", "msetnx", "del", "setex", "psetex", *MOVES)),
        many.select("seq", F.lit("set").alias("cmd"), "key", F.array("val").alias("args")),
        log.where(of("del")).select("seq", "cmd", F.explode(F.array_distinct(words)).alias("key"), none.alias("args")),
        log.where(of("setex", "psetex")).select("seq", F.lit("set").alias("cmd"), "key", F.slice("args", 2, 1).alias("args")),
    ])
    abroad = F.exists(F.slice("args", 2, 9), lambda x: F.lower(x) == "db")
    dst = F.when(abroad, F.raise_error(F.lit("no fold for copy to another database")).cast("string")).otherwise(F.get("args", F.lit(0)))
    moves = log.where(of(*MOVES)).select("seq", F.col("key").alias("src"), dst.alias("dst"), (F.col("cmd") == "copy").alias("copied")).where("src <> dst")
    begins = F.when(F.col("copied"), 0).otherwise(1).cast("long")
    ends = moves.select(F.col("dst").alias("key"), "seq", F.lit(1).cast("long").alias("begins"), F.lit("to").alias("role")).unionByName(moves.select(F.col("src").alias("key"), "seq", begins.alias("begins"), F.lit("from").alias("role")))
    keys = ends.select("key").distinct()
    rows = told.join(keys, "key", "left_semi").withColumn("begins", F.lit(0).cast("long")).withColumn("role", F.lit("row"))
    spark = log.sparkSession
    path = shared_folder(spark, "moves")

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    held = staged(numbering.running(rows.unionByName(ends, allowMissingColumns=True), ["seq"], F.col("begins"), "stretch"), "held")
    into = held.where("role = 'to'").select("seq", F.col("key").alias("dst"), F.col("stretch").alias("into"))
    links = staged(into.join(held.where("role = 'from'").select("seq", F.col("key").alias("src"), (F.col("stretch") - F.col("begins")).alias("out")), "seq"), "links")
    last = held.where("role <> 'row'").groupBy("key").agg(F.max("stretch").alias("stretch"))
    step = staged(last.select(F.col("key").alias("name"), "key", "stretch", F.lit(None).cast("long").alias("upto")), "0")
    reached = [step]
    while True:
        found = step.join(links, (F.col("key") == F.col("dst")) & (F.col("stretch") == F.col("into"))).select("name", F.col("src").alias("key"), F.col("out").alias("stretch"), F.col("seq").alias("upto"))
        step = staged(found, str(len(reached)))
        if step.isEmpty():
            break
        reached.append(step)
    moved = held.where("role = 'row'").join(reduce(DataFrame.unionByName, reached), ["key", "stretch"]).where("upto is null or seq < upto")
    return told.join(keys, "key", "left_anti").select("seq", "cmd", "key", "args").unionByName(moved.select("seq", "cmd", F.col("name").alias("key"), "args"))


def effective(log: DataFrame) -> DataFrame:
    """The log without what a later delete of its key or flush of the database undoes, and without those."""
    log = covered(log)
    flushed = log.where(F.col("cmd").isin(*FLUSHES)).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("flushed"))  # one row
    rows = log.where(~F.col("cmd").isin(*FLUSHES)).join(F.broadcast(flushed), F.col("seq") > F.col("flushed")).drop("flushed")
    # a delete may name further keys among its arguments
    named = F.when(F.col("cmd") == "del", F.concat(F.array("key"), F.coalesce("args", F.array().cast("array<string>")))).otherwise(F.array("key"))
    resets = rows.where(F.col("cmd").isin(*RESETS) | ((F.col("cmd") == "set") & (F.size("args") == 1))).select("seq", F.explode(named).alias("key")).groupBy("key").agg(F.max("seq").alias("reset"))
    kept = rows.join(resets, "key", "left").where(F.col("reset").isNull() | (F.col("seq") > F.col("reset")) | ((F.col("seq") == F.col("reset")) & (F.col("cmd") == "set")))
    return kept.drop("reset").where(~F.col("cmd").isin(*RESETS))


def strings(log: DataFrame) -> DataFrame:
    """key, value of set, setnx, getset and counters: the last full write, and what was added since. Keys with append or setrange
    are replayed."""
    rows, edited = _split(covered(log).where(F.col("cmd").isin(*STRINGS, *STRINGS_ORDERED)), STRINGS_ORDERED)
    number = F.when(F.col("cmd") == "incr", 1).when(F.col("cmd") == "decr", -1).when(F.col("cmd") == "incrby", F.col("args")[0].try_cast("long")).when(F.col("cmd") == "decrby", -F.col("args")[0].try_cast("long"))
    # a setnx writes only where it opens the key's history
    full = F.max(F.when(F.col("cmd").isin("set", "getset"), F.col("seq")))
    opened = F.when(F.min_by("cmd", "seq") == "setnx", F.min("seq"))
    rows = numbering.with_totals(rows.withColumn("d", number), ["key"], base=F.coalesce(full, opened))
    out = rows.groupBy("key").agg(F.max(F.when(F.col("seq") == F.col("base"), F.col("args")[0])).alias("text"), F.try_sum(F.when(F.col("base").isNull() | (F.col("seq") > F.col("base")), F.col("d"))).alias("added"))
    # a step on a text that is no integer, or beyond 64 bits, is an error and changes nothing
    counted = F.try_add(F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(strict_int(F.col("text"))), F.col("added"))
    plain = out.select("key", F.coalesce(counted.cast("string"), "text").alias("value"))
    return plain.unionByName(_replayed(edited).where("pos < 0").select("key", F.col("val").alias("value")))


def hashes(log: DataFrame) -> DataFrame:
    """key, field, val of hset, hmset (field, value pairs), hsetnx, hincrby and hdel."""
    pairs = F.when(F.col("cmd") == "hdel", F.transform("args", lambda f: F.struct(f.alias("f"), F.lit(None).cast("string").alias("v")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size("args") / 2).cast("int") - 1)), lambda i: F.struct(F.get("args", 2 * i).alias("f"), F.get("args", 2 * i + 1).alias("v")))
    )
    rows = covered(log).where(F.col("cmd").isin("hset", "hmset", "hsetnx", "hincrby", "hdel")).select("key", "seq", "cmd", F.posexplode(pairs).alias("nth", "p")).select("key", "seq", "cmd", "nth", F.col("p.f").alias("field"), F.col("p.v").alias("val"))
    at = F.struct("seq", "nth")
    rows = numbering.with_totals(rows, ["key", "field"], gone=F.max(F.when(F.col("cmd") == "hdel", at)), base=F.max(F.when(F.col("cmd").isin("hset", "hmset"), at)))
    rows = rows.where(F.col("gone").isNull() | (at > F.col("gone"))).withColumn("base", F.when(F.col("gone").isNull() | (F.col("base") > F.col("gone")), F.col("base")))
    first = F.min_by(F.when(F.col("cmd") == "hsetnx", F.col("val")), at)
    total = F.try_sum(F.when((F.col("cmd") == "hincrby") & (F.col("base").isNull() | (at > F.col("base"))), F.col("val").try_cast("long")))
    out = rows.groupBy("key", "field").agg(F.max(F.when(at == F.col("base"), F.col("val"))).alias("b"), first.alias("f"), total.alias("t"))
    text = F.coalesce("b", "f")
    counted = F.try_add(F.when(text.isNull(), F.lit(0).cast("long")).otherwise(strict_int(text)), F.col("t"))
    return out.select("key", "field", F.coalesce(counted.cast("string"), text).alias("val"))


def sets(log: DataFrame) -> DataFrame:
    """key, member: the last of sadd and srem decides."""
    rows = covered(log).where(F.col("cmd").isin("sadd", "srem")).select("key", "seq", "cmd", F.explode("args").alias("member"))
    return rows.groupBy("key", "member").agg(F.max_by("cmd", "seq").alias("last")).where("last = 'sadd'").select("key", "member")


def zsets(log: DataFrame) -> DataFrame:
    """key, member, score of zadd (score, member pairs), zincrby (delta, member) and zrem. Keys with zpopmin or a range removal are
    replayed."""
    log, cut = _split(covered(log).where(F.col("cmd").isin(*ZSETS, *ZSETS_ORDERED)), ZSETS_ORDERED)
    pairs = F.when(F.col("cmd") == "zrem", F.transform("args", lambda m: F.struct(m.alias("m"), F.lit(None).cast("string").alias("s")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size("args") / 2).cast("int") - 1)), lambda i: F.struct(F.get("args", 2 * i + 1).alias("m"), F.get("args", 2 * i).alias("s")))
    )
    rows = log.where(F.col("cmd").isin("zadd", "zincrby", "zrem")).select("key", "seq", "cmd", F.posexplode(pairs).alias("nth", "p")).select("key", F.struct("seq", "nth").alias("at"), "cmd", F.col("p.m").alias("member"), F.col("p.s").try_cast("double").alias("score"))
    rows = numbering.with_totals(rows, ["key", "member"], gone=F.max(F.when(F.col("cmd") == "zrem", F.col("at"))), base=F.max(F.when(F.col("cmd") == "zadd", F.col("at"))))
    rows = rows.where("gone is null or at > gone").withColumn("base", F.expr("case when gone is null or base > gone then base end"))
    plain = rows.where("base is null or at >= base").groupBy("key", "member").agg(F.sum("score").alias("score"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        scores = replay_scores([(c, list(a)) for c, a in zip(pdf.cmd, pdf.args)])
        return pd.DataFrame([(pdf.key.iloc[0], m, x) for m, x in scores.items()], columns=["key", "member", "score"])

    return plain.unionByName(cut.select("key", "seq", "cmd", "args").groupBy("key").applyInPandas(run, "key string, member string, score double"))


def expiries(log: DataFrame) -> DataFrame:
    """key, expire_at_ms of pexpireat and persist; a plain set clears it too."""
    rows = covered(log).where(F.col("cmd").isin("pexpireat", "persist", "set", "getset"))
    at = F.when(F.col("cmd") == "pexpireat", F.col("args")[0].try_cast("long"))
    return rows.groupBy("key").agg(F.max_by(at, "seq").alias("expire_at_ms")).where("expire_at_ms is not null")


def appended_lists(log: DataFrame) -> DataFrame:
    """key, pos, val of keys that only ever saw rpush: no replay needed."""
    rows = covered(log).where(F.col("cmd") == "rpush").select("key", "seq", F.posexplode("args").alias("nth", "val"))
    return numbering.numbered(rows, ["seq", "nth"], "pos").select("key", "pos", "val")


def lists(log: DataFrame) -> DataFrame:
    """key, pos, val of every key with list commands; only those with others than rpush are replayed."""
    pushed, edited = _split(covered(log).where(F.col("cmd").isin("rpush", *LISTS_ORDERED)), LISTS_ORDERED)
    return appended_lists(pushed).unionByName(_replayed(edited).where("pos >= 0"))


def _integer(text: str) -> int | None:
    """A 64-bit integer, or None."""
    n = int(text) if re.fullmatch(r"[+-]?[0-9]{1,19}", text) else None
    return n if n is not None and -(2**63) <= n < 2**63 else None


def replay(commands: list[tuple[str, list[str]]]) -> tuple[list[str], str | None]:
    """A list and a string from one key's commands in order. Unknown or ill-formed ones change nothing."""
    items: list[str] = []
    text: str | None = None
    for cmd, args in commands:
        if cmd == "rpush":
            items.extend(args)
        elif cmd == "lpush":
            items[:0] = args[::-1]
        elif cmd in ("lpop", "rpop"):
            n = int(args[0]) if args else 1
            items = (items[n:] if cmd == "lpop" else items[: max(len(items) - n, 0)]) if n >= 0 else items
        elif cmd == "lrem":
            n, val = int(args[0]), args[1]
            where = [i for i, x in enumerate(items) if x == val]
            gone = set(where if not n else where[:n] if n > 0 else where[n:])
            items = [x for i, x in enumerate(items) if i not in gone]
        elif cmd == "lset":
            i = int(args[0]) + (len(items) if int(args[0]) < 0 else 0)
            if 0 <= i < len(items):
                items[i] = args[1]
        elif cmd == "linsert":
            if args[1] in items:
                items.insert(items.index(args[1]) + (args[0].lower() == "after"), args[2])
        elif cmd == "ltrim":
            n, (a, b) = len(items), map(int, args[:2])
            a = max(0, a + n if a < 0 else a)
            items = items[a : max(a, b + 1 + (n if b < 0 else 0))]
        elif cmd == "append":
            text = (text or "") + args[0]
        elif cmd == "setrange":
            at, put = int(args[0]), args[1]
            old = (text or "").ljust(at, "\0")
            text = old[:at] + put + old[at + len(put) :]
        elif cmd in ("set", "getset") or (cmd == "setnx" and text is None):
            text = args[0]
        elif cmd in ("incr", "decr", "incrby", "decrby"):
            old, step = 0 if text is None else _integer(text), _integer(args[0]) if cmd.endswith("by") else 1
            if old is not None and step is not None:
                new = old - step if cmd.startswith("decr") else old + step
                text = str(new) if -(2**63) <= new < 2**63 else text
    return items, text


def replay_scores(commands: list[tuple[str, list[str]]]) -> dict[str, float]:
    """member to score from one key's sorted-set commands in order; ranks are by score, then member."""
    from cairn.operators.zsets import border

    scores: dict[str, float] = {}
    for cmd, args in commands:
        gone: list[str] = []
        if cmd in ("zadd", "zincrby"):
            for text, member in zip(args[::2], args[1::2]):
                try:
                    score = float(text)
                except ValueError:
                    continue
                if not math.isnan(score):
                    scores[member] = score + (scores.get(member, 0.0) if cmd == "zincrby" else 0.0)
        elif cmd == "zrem":
            gone = args
        elif cmd == "zpopmin":
            gone = sorted(scores, key=lambda m: (scores[m], m))[: max(0, int(args[0]) if args else 1)]
        elif cmd == "zremrangebyrank":
            n, (a, b) = len(scores), map(int, args[:2])
            a, b = max(0, a + n if a < 0 else a), b + 1 + (n if b < 0 else 0)
            gone = sorted(scores, key=lambda m: (scores[m], m))[a : max(a, b)]
        elif cmd == "zremrangebyscore":
            (a, a_open), (b, b_open) = border(args[0]), border(args[1])
            gone = [m for m, x in scores.items() if (x > a if a_open else x >= a) and (x < b if b_open else x <= b)]
        elif cmd == "zremrangebylex":
            low, high = args[:2]
            above = lambda m: low == "-" or (low[:1] == "[" and m >= low[1:]) or (low[:1] == "(" and m > low[1:])
            below = lambda m: high == "+" or (high[:1] == "[" and m <= high[1:]) or (high[:1] == "(" and m < high[1:])
            gone = [m for m in scores if above(m) and below(m)]
        for member in gone:
            scores.pop(member, None)
    return scores


def _replayed(rows: DataFrame) -> DataFrame:
    """key, pos, val of lists, and of strings with pos -1: each key is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        items, text = replay([(c, list(a)) for c, a in zip(pdf.cmd, pdf.args)])
        out = [(pdf.key.iloc[0], i, v) for i, v in enumerate(items)]
        if text is not None:
            out.append((pdf.key.iloc[0], -1, text))
        return pd.DataFrame(out, columns=["key", "pos", "val"])

    return rows.select("key", "seq", "cmd", "args").groupBy("key").applyInPandas(run, "key string, pos long, val string")


def ordered(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lists (key, pos, val) and strings (key, value) of keys with commands whose order matters."""
    log = covered(log)
    keys = log.where(F.col("cmd").isin(*ORDERED)).select("key").distinct()
    rows = log.where(F.col("cmd").isin(*ORDERED, "rpush", *STRINGS)).join(keys, "key", "left_semi")
    done = _replayed(rows)
    return done.where("pos >= 0"), done.where("pos < 0").select("key", F.col("val").alias("value"))


#: Arguments that one command of a compacted log holds, about.
MEMBERS = 65_536


def compact(strings_: DataFrame, lists: DataFrame, hashes_: DataFrame, sets_: DataFrame, zsets_: DataFrame) -> DataFrame:
    """cmd, key, args: commands that rebuild each key, in order of part for lists; a key of more than MEMBERS members takes several."""
    held = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    flat = lambda rows, a, b: F.flatten(F.transform(rows, lambda x: F.array(x[a], x[b])))
    size = F.ceil(F.count(F.lit(1)) / MEMBERS)

    def dealt(rows: DataFrame, what: str):
        return numbering.with_totals(rows, ["key"], parts=size).withColumn("part", F.pmod(F.xxhash64(what), "parts")).groupBy("key", "part")

    made = [
        strings_.select(F.lit("set").alias("cmd"), "key", F.lit(0).cast("long").alias("part"), F.array("value").alias("args")),
        lists.withColumn("part", F.floor(F.col("pos") / MEMBERS)).groupBy("key", "part").agg(F.transform(held("pos", "val"), lambda x: x["val"]).alias("args")).select(F.lit("rpush").alias("cmd"), "key", "part", "args"),
        dealt(hashes_, "field").agg(flat(held("field", "val"), "field", "val").alias("args")).select(F.lit("hmset").alias("cmd"), "key", "part", "args"),
        dealt(sets_, "member").agg(F.sort_array(F.collect_list("member")).alias("args")).select(F.lit("sadd").alias("cmd"), "key", "part", "args"),
        dealt(zsets_.withColumn("s", float_text("score")), "member").agg(flat(held("score", "member", "s"), "s", "member").alias("args")).select(F.lit("zadd").alias("cmd"), "key", "part", "args"),
    ]
    return reduce(DataFrame.unionByName, made)
