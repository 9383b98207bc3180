"""Numbers, sums and former values within keys, one key holding nine tenths of the rows, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import numbering
from cairn.operators import lists, sampling, zsets

ROWS = [("hot" if i % 10 else f"k{i % 7}", i * 3 - 500, None if i % 11 == 0 else i % 17) for i in range(2000)]


@pytest.fixture
def rows(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SPAN", 256)
    shuffled = random.Random(1).sample(ROWS, len(ROWS))
    return spark.createDataFrame(shuffled, "key string, seq long, value long").repartition(6)


def of_key(key):
    return [r for r in ROWS if r[0] == key]


def test_running_numbered_and_former(rows):
    summed = {(r["key"], r["seq"]): r["s"] for r in numbering.running(rows, ["seq"], F.col("value"), "s").collect()}
    places = {(r["key"], r["seq"]): r["n"] for r in numbering.numbered(rows, ["seq"], "n").collect()}
    before = {(r["key"], r["seq"]): r["f"] for r in numbering.former(rows, "seq", "value", "f").collect()}
    for key in {r[0] for r in ROWS}:
        total, last = None, None
        for n, (_, seq, value) in enumerate(of_key(key)):
            total = value if total is None else total + (value or 0)
            assert (summed[key, seq], places[key, seq], before[key, seq]) == (total, n, last)
            last = value
    assert len(summed) == len(places) == len(before) == len(ROWS)


def test_no_task_numbers_a_whole_key(rows):
    """Rows of the hot key meet in windows by span: at most SPAN integers each."""
    held = numbering.numbered(rows, ["seq"], "n").groupBy("key", F.floor(F.col("seq") / numbering.SPAN)).count()
    assert held.agg(F.max("count")).first()[0] <= numbering.SPAN // 3 + 1
    plan = numbering.numbered(rows, ["seq"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "Window [sum(amount" in plan and "key#" in plan and "span#" in plan


def test_rows_without_key_or_place(spark):
    odd = spark.createDataFrame([(None, 1, 5), ("a", None, 6), ("a", 1, 7), ("a", 2, 8)], "key string, seq long, value long")
    assert sorted((r["value"], r["n"]) for r in numbering.numbered(odd, ["seq"], "n").collect() if r["n"] is not None) == [(7, 0), (8, 1)]
    assert numbering.numbered(odd, ["seq"], "n").count() == 4
    assert numbering.running(odd.limit(0), ["seq"], F.col("value"), "s").count() == 0


def test_ranked(rows):
    found = {(r["key"], r["seq"]): r["n"] for r in numbering.ranked(rows, [F.desc("value"), F.asc("seq")], "n").collect()}
    for key in {r[0] for r in ROWS}:
        order = sorted(of_key(key), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        assert [found[key, seq] for _, seq, _ in order] == list(range(len(order)))


def test_totals(rows):
    got = numbering.with_totals(rows, ["key"], n=F.count("value")).select("key", "n").distinct().collect()
    assert {r["key"]: r["n"] for r in got} == {k: sum(r[2] is not None for r in of_key(k)) for k in {r[0] for r in ROWS}}


def test_lists_of_a_hot_key(rows):
    """Every rewrite of positions against Python's lists."""
    held = numbering.numbered(rows.where("value is not null").withColumn("val", F.col("value").cast("string")), ["seq"], "pos").select("key", "pos", "val")
    plain = {k: [str(r[2]) for r in of_key(k) if r[2] is not None] for k in {r[0] for r in ROWS}}

    def same(made, expect):
        got = {}
        for r in sorted(made.collect(), key=lambda r: r["pos"]):
            assert r["pos"] == len(got.setdefault(r["key"], []))
            got[r["key"]].append(r["val"])
        assert got == {k: v for k, v in expect.items() if v}

    def without(values, count, val):
        at = [i for i, v in enumerate(values) if v == val]
        gone = set(at if count == 0 else at[:count] if count > 0 else at[count:])
        return [v for i, v in enumerate(values) if i not in gone]

    same(held, plain)
    for count in (0, 2, -2):
        same(lists.remove(held, count, "5"), {k: without(v, count, "5") for k, v in plain.items()})
    for start, stop in ((3, -4), (-9, -2), (0, 5), (500, 3), (-5, 1)):
        cut = {k: v[(max(start + len(v), 0) if start < 0 else start) : (stop + len(v) + 1 if stop < 0 else stop + 1)] if stop >= 0 or len(v) + stop + 1 > 0 else [] for k, v in plain.items()}
        same(lists.trim(held, start, stop), cut)
    new = rows.sparkSession.createDataFrame([("hot", 4, "x"), ("hot", 9, "y"), ("fresh", 1, "z")], "key string, nth long, val string")
    same(lists.push_right(held, new), plain | {"hot": plain["hot"] + ["x", "y"], "fresh": ["z"]})
    same(lists.push_left(held, new), plain | {"hot": ["y", "x"] + plain["hot"], "fresh": ["z"]})
    same(lists.push_left(held, new, only_existing=True), plain | {"hot": ["y", "x"] + plain["hot"]})
    put = lambda v: v[: v.index("5") + 1] + ["new"] + v[v.index("5") + 1 :] if "5" in v else v
    same(lists.insert(held, "5", "new", after=True), {k: put(v) for k, v in plain.items()})


def test_ranks_of_a_hot_key(rows):
    held = rows.select("key", F.col("seq").cast("string").alias("member"), F.coalesce("value", F.lit(0)).cast("double").alias("score"))
    order = {k: [m for _, m in sorted((float(r[2] or 0), str(r[1])) for r in of_key(k))] for k in {r[0] for r in ROWS}}
    for start, stop in ((0, 3), (2, -3), (-4, -2), (-5, 2), (3, 1)):
        cut = {k: [(i, m) for i, m in enumerate(v) if max(start if start >= 0 else len(v) + start, 0) <= i <= (stop if stop >= 0 else len(v) + stop)] for k, v in order.items()}
        got = {(r["key"], r["rank"], r["member"]) for r in zsets.by_rank(held, start, stop).collect()}
        assert got == {(k, i, m) for k, v in cut.items() for i, m in v}
        left = {(r["key"], r["member"]) for r in zsets.remove_by_rank(held, start, stop).collect()}
        assert left == {(k, m) for k, v in order.items() for m in v} - {(k, m) for k, _, m in got}
    taken, rest = zsets.pop_min(held, 4)
    assert {(r["key"], r["member"]) for r in taken.collect()} == {(k, m) for k, v in order.items() for m in v[:4]}
    assert rest.count() == len(ROWS) - taken.count()
    assert sampling.sample(held, "member", -3, seed=1).count() == 3 * len(order)
