"""Folds of a command log that holds commands whose order matters, and of one that holds commands no fold reads."""

import random

import pytest

from cairn import catalog
from cairn.operators import strings
from cairn.plans import fold, transactions
from cairn.sources import wire
from tests.conftest import SF


def logged(spark, commands):
    return spark.createDataFrame([(i, c, k, list(a)) for i, (c, k, *a) in enumerate(commands)], "seq long, cmd string, key string, args array<string>")


def test_zsets_with_pops_and_range_removals(spark):
    four = lambda key: [("zadd", key, "1", "a", "2", "b", "2", "c", "3", "d")]
    log = logged(spark, [
        *four("pop"), ("zpopmin", "pop", "2"), ("zadd", "pop", "9", "a"), ("zpopmin", "pop"),
        *four("rank"), ("zremrangebyrank", "rank", "1", "-2"), ("zincrby", "rank", "5", "b"),
        *four("score"), ("zremrangebyscore", "score", "(1", "2"),
        *four("lex"), ("zremrangebylex", "lex", "[b", "(d"), *four("plain"), ("zrem", "plain", "a"),
    ])
    found = {}
    for r in fold.zsets(fold.effective(log)).collect():
        found.setdefault(r.key, {})[r.member] = r.score
    assert found == {"pop": {"d": 3, "a": 9}, "rank": {"a": 1, "d": 3, "b": 5}, "score": {"a": 1, "d": 3}, "lex": {"a": 1, "d": 3}, "plain": {"b": 2, "c": 2, "d": 3}}


def test_strings_before_and_after_edits(spark):
    log = logged(spark, [
        ("setnx", "n", "ab"), ("append", "n", "c"), ("setnx", "n", "x"), ("getset", "g", "old"), ("getset", "g", "new"), ("setrange", "g", "1", "OW"),
        ("incr", "i"), ("incrby", "i", "41"), ("append", "i", "0"), ("decr", "i"), ("decrby", "i", "9"), ("set", "s", "5"), ("incr", "s"),
    ])
    expected = {"n": "abc", "g": "nOW", "i": "410", "s": "6"}
    assert {r.key: r.value for r in fold.strings(log).collect()} == expected
    del expected["s"]
    assert {r.key: r.value for r in fold.ordered(log)[1].collect()} == expected


def test_lists_of_pushed_and_edited_keys(spark):
    log = logged(spark, [("rpush", "p", "a", "b"), ("rpush", "e", "a", "b"), ("lpop", "e"), ("rpush", "p", "c"), ("lpush", "e", "z")])
    found = {}
    for r in fold.lists(log).orderBy("key", "pos").collect():
        found.setdefault(r.key, []).append(r["val"])
    assert found == {"p": ["a", "b", "c"], "e": ["z", "b"]}


@pytest.mark.parametrize("command", [("rename", "a", "b"), ("copy", "a", "b"), ("rpoplpush", "a", "b"), ("msetnx", "a", "1"), ("spop", "a"), ("sunionstore", "a", "b")])
def test_a_command_that_no_fold_reads_raises(spark, command):
    log = logged(spark, [("sadd", "a", "x"), command])
    for f in (fold.sets, fold.strings, fold.zsets, fold.effective):
        with pytest.raises(Exception, match="no fold for the command " + command[0]):
            f(log).collect()


def test_errors_keep_values_and_deletes_name_several_keys(spark):
    most = str(2**63 - 1)
    log = logged(spark, [
        ("set", "t", "abc"), ("incr", "t"), ("set", "m", most), ("incr", "m"), ("set", "n", "5"), ("incrby", "n", "x"), ("incr", "n"),
        ("hset", "h", "f", "abc", "g", most, "i", "4"), ("hincrby", "h", "f", "1"), ("hincrby", "h", "g", "1"), ("hincrby", "h", "i", "3"),
        ("set", "a", "1"), ("set", "b", "2"), ("set", "c", "3"), ("del", "a", "b"), ("set", "b", "4"),
    ])
    kept = fold.effective(log)
    assert {r.key: r.value for r in fold.strings(kept).collect()} == {"t": "abc", "m": most, "n": "6", "c": "3", "b": "4"}
    assert {r.field: r["val"] for r in fold.hashes(kept).collect()} == {"f": "abc", "g": most, "i": "7"}


def test_log_files_with_databases_and_a_torn_end(spark, tmp_path):
    frames = [[b"select", b"3"], [b"set", b"k", b"v"], [b"select", b"0"], [b"del", b"a", b"b"]]
    data = b"".join(map(wire.encode_command, frames))
    (tmp_path / "part-000000.aof").write_bytes(data)
    (tmp_path / "part-000001.aof").write_bytes(wire.encode_command([b"set", b"x", b"y"]) + data[:-9])
    rows = [(r.db, r.cmd, r.key, list(r.args)) for r in wire.read_log(spark, f"file://{tmp_path}").orderBy("file", "nth").collect()]
    assert rows == [(3, "set", "k", ["v"]), (0, "del", "a", ["b"]), (0, "set", "x", ["y"]), (3, "set", "k", ["v"])]


def test_versions_of_a_key_with_most_of_the_log(spark, monkeypatch):
    monkeypatch.setattr(transactions, "SPAN", 8)
    commands = [(i, "hot" if i % 10 else "cold") for i in range(100)]
    asks = [(k, at) for k in ("hot", "cold", "none") for at in (0, 1, 7, 8, 50, 99, 250)]
    found = transactions.versions_at(spark.createDataFrame(commands, "seq long, key string"), spark.createDataFrame(asks, "key string, at long"))
    assert {(r.key, r["at"]): r.version for r in found.collect()} == {(k, at): sum(x == k and i < at for i, x in commands) for k, at in asks}


def test_ranges_that_cut_a_character(spark):
    rows = spark.createDataFrame([("k", "h\u00e9llo")], "key string, value string")
    part = lambda *r: bytes(strings.get_range(rows, *r).selectExpr("cast(part as binary) b").first().b)
    assert (part(0, 1), part(1, 2), part(2, -1)) == (b"h\xc3", b"\xc3\xa9", b"\xa9llo")
    assert bytes(strings.set_range(rows, 2, "x").selectExpr("cast(value as binary) b").first().b) == b"h\xc3xllo"


def test_compacted_log_folds_to_the_same(spark, monkeypatch):
    """Large keys take several commands, and reading them back restores every relation."""
    monkeypatch.setattr(fold, "MEMBERS", 7)
    n = range(60)
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    held = [
        of([("s", "v")], "key string, value string"), of([("l", i, f"e{i % 9}") for i in n], "key string, pos long, val string"), of([("h", f"f{i}", str(i)) for i in n], "key string, field string, val string"),
        of([("m", f"x{i}") for i in n], "key string, member string"), of([("z", f"x{i}", i / 4) for i in n], "key string, member string, score double"),
    ]
    made = fold.compact(*held)
    assert made.groupBy("key").count().where("count > 5").count() == 4
    rows = sorted(made.collect(), key=lambda r: (r["key"], r["part"]))
    log = of([(seq, r["key"], r["cmd"], r["args"]) for seq, r in enumerate(rows)], "seq long, key string, cmd string, args array<string>")
    for read, was in zip((fold.strings, fold.lists, fold.hashes, fold.sets, fold.zsets), held):
        assert sorted(map(tuple, read(log).select(was.columns).collect())) == sorted(map(tuple, was.collect()))


def simulated(n, seed):
    """A log of commands that all take effect, and the key space they leave: strings as text, counters too, lists, sets."""
    deal, held, out = random.Random(seed), {}, []
    for _ in range(n):
        cmd, a, b = deal.choice("set mset msetnx setex incr rpush sadd del rename rename renamenx copy copy".split()), *deal.sample("abcdefg", 2)
        v, now = str(deal.randrange(100)), held.get(a)
        if cmd in ("set", "setex"):
            held[a], args = v, [v] if cmd == "set" else ["10", v]
        elif cmd == "mset" or (cmd == "msetnx" and a not in held and b not in held):
            held[a], held[b], args = "9", v, [v, b, v, a, "9"]
        elif cmd == "incr" and (now is None or isinstance(now, str)):
            held[a], args = str(int(now or 0) + 1), []
        elif cmd == "rpush" and (now is None or isinstance(now, list)):
            held[a], args = [*(now or []), v], [v]
        elif cmd == "sadd" and (now is None or isinstance(now, frozenset)):
            held[a], args = (now or frozenset()) | {v}, [v]
        elif cmd == "del":
            held, args = {k: x for k, x in held.items() if k not in (a, b)}, [b]
        elif cmd in ("rename", "renamenx", "copy") and now is not None and (cmd == "rename" or b not in held):
            held[b], args = now, [b]
            if cmd != "copy":
                del held[a]
        else:
            continue
        out.append((cmd, a, *args))
    return out, held


@pytest.mark.parametrize("seed", [1, 2])
def test_moves_against_a_plain_key_space(spark, seed):
    log, held = simulated(140, seed)
    assert {"rename", "renamenx", "copy", "mset", "del"} <= {c for c, *_ in log}
    kept = fold.effective(fold.settled(logged(spark, log)))
    found = {r.key: r.value for r in fold.strings(kept).collect()}
    for r in fold.lists(kept).orderBy("key", "pos").collect():
        found.setdefault(r.key, []).append(r["val"])
    for r in fold.sets(kept).collect():
        found[r.key] = found.get(r.key, frozenset()) | {r.member}
    assert found == held


def test_moves_at_the_edges(spark):
    log = logged(spark, [("set", "a", "1"), ("rename", "a", "a"), ("copy", "a", "b", "REPLACE"), ("rename", "nosuch", "c"), ("incr", "b"), ("set", "x", "7")])
    assert {r.key: r.value for r in fold.strings(fold.effective(fold.settled(log))).collect()} == {"a": "1", "b": "2", "x": "7"}
    assert fold.settled(log.limit(0)).count() == 0
    with pytest.raises(Exception, match="no fold for copy to another database"):
        fold.settled(logged(spark, [("set", "a", "1"), ("copy", "a", "b", "db", "1")])).collect()


def test_state_reads_the_log_files_once(spark):
    """The folds read what was kept of the files: none of their branches goes back to the Python source."""
    plan = catalog.QUERIES["log_fold_state"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "cairn_log" not in plan


def test_texts_are_encoded_like_commands():
    commands = [("set", "k", "héllo €"), ("del", "a", ""), ("rpush", "l", "x\r\ny")]
    assert wire.encode_texts(commands) == b"".join(wire.encode_command([w.encode() for w in c]) for c in commands)
