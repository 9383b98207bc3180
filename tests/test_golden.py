"""Known answers of single operators."""

import io

import pandas as pd
import pytest

from cairn.functions import geohash, patterns
from cairn.operators import bitmaps, lists, sets, zsets
from cairn.sources import wire


@pytest.fixture
def list_100(spark):
    return spark.createDataFrame([("k", i, str(i)) for i in range(100)], "key string, pos long, val string")


@pytest.mark.parametrize(("start", "stop", "n"), [(0, 9, 10), (0, 200, 100), (0, -10, 91), (0, -200, 0), (-10, -1, 10)])
def test_list_between(list_100, start, stop, n):
    assert lists.between(list_100, start, stop).count() == n


def test_list_insert_and_trim(spark):
    six = spark.createDataFrame([("k", i, c) for i, c in enumerate("abcdef")], "key string, pos long, val string")
    values = lambda df: [r["val"] for r in df.orderBy("pos").collect()]
    assert values(lists.insert(six, "d", "x")) == list("abcxdef")
    assert values(lists.insert(six, "d", "x", after=True)) == list("abcdxef")
    assert values(lists.insert(six, "z", "x")) == list("abcdef")
    assert values(lists.trim(six, 1, -2)) == list("bcde")


def test_set_algebra(spark):
    four = spark.createDataFrame([(f"s{i}", str(v)) for i in range(4) for v in range(10 * i, 10 * i + 100)], "key string, member string")
    assert sets.intersect(four, ["s0", "s1", "s2", "s3"]).count() == 70
    assert sets.union(four, ["s0", "s1", "s2", "s3"]).count() == 130
    three = spark.createDataFrame([(f"s{i}", str(v)) for i in range(3) for v in range(20 * i, 20 * i + 100)], "key string, member string")
    assert sets.subtract(three, "s0", "s1", "s2").count() == 20


@pytest.mark.parametrize(("low", "high", "n"), [("20", "30", 11), ("-10", "10", 11), ("90", "110", 10), ("(20", "(30", 9)])
def test_zset_count(spark, low, high, n):
    z = spark.createDataFrame([("z", str(i), float(i)) for i in range(100)], "key string, member string, score double")
    assert zsets.by_score(z, low, high).count() == n
    assert zsets.count(z, low, high).collect()[0][-1] == n


@pytest.mark.parametrize(("low", "high", "found"), [("-", "+", "abcde"), ("[a", "(e", "abcd"), ("(aa", "(ee", "bcde")])
def test_zset_by_lex(spark, low, high, found):
    z = spark.createDataFrame([("z", c, 0.0) for c in "abcde"], "key string, member string, score double")
    assert sorted(r["member"] for r in zsets.by_lex(z, low, high).collect()) == list(found)


def test_bits(spark):
    bits = spark.createDataFrame([("b", 13), ("b", 15)], "key string, off long")
    assert bitmaps.count_range(bits, 14, 15, "BIT").collect()[0][-1] == 1
    assert bitmaps.count_range(bits, 1, 1, "BYTE").collect()[0][-1] == 2


def test_geohash():
    code, _ = geohash.encode(pd.Series([13.361389]).to_numpy(), pd.Series([38.115556]).to_numpy())
    lng, lat = geohash.decode(code)
    assert (lng[0], lat[0]) == pytest.approx((13.361386698670685, 38.11555536696687))


def test_glob():
    import re

    names = ["k", "a:k", "b:k"]
    assert [len([n for n in names if re.fullmatch(patterns.glob_to_regex(p), n)]) for p in ("*", "a:*", "?:*")] == [3, 1, 2]


def test_wire_round_trip():
    words = [b"SET", b"k", b"line\r\nbreak"]
    assert list(wire.decode(io.BytesIO(wire.encode_command(words)))) == [words]
