"""Deletes and moves over a key space of several relations: right, and with one join that no part of the key space repeats."""

from cairn.operators import keys
from cairn.sources.keyspace import KeySpace
from tests.conftest import SF


def plan(df, name):
    return getattr(df._jdf.queryExecution(), name)().toString()


def asked(spark):
    return spark.createDataFrame([("evt:1",), ("evt:1",), ("nation:3",), ("nosuch",), (None,)], "key string")


def test_deleted_count_joins_the_requests_once(spark):
    held = KeySpace(spark, SF).keys()
    df = keys.deleted_count(held, asked(spark))
    assert df.first().n == 2
    assert plan(df, "optimizedPlan").count("Join ") == 1
    assert "Window" not in plan(held, "optimizedPlan")


def test_many_small_partitions_are_not_merged(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert keys.dealt(spark.range(100).selectExpr("string(id) as key")).rdd.getNumPartitions() == 37
        joined = keys.dealt(spark.range(100).selectExpr("string(id) as key")).join(asked(spark).distinct(), "key", "left")
        assert joined.rdd.getNumPartitions() == 37
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_delete_joins_the_requests_once(spark):
    held = KeySpace(spark, SF).keys()
    df = keys.delete(held, asked(spark))
    assert df.columns == held.columns and df.count() == held.count() - 2
    assert df.where("key in ('evt:1', 'nation:3')").isEmpty()
    assert plan(df, "optimizedPlan").count("Join ") == 1


def test_delete_keeps_null_keys_and_repeated_rows(spark):
    held = spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (3, "evt:1"), (4, "evt:1")], "n int, key string")
    assert sorted(map(tuple, keys.delete(held, asked(spark)).collect())) == [(1, None), (2, "a"), (2, "a")]
