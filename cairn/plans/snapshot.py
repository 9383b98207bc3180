"""Snapshots of a key space: each relation a Parquet table in one folder, with a list of what is there written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

LISTED = "_snapshot"


def save(relations: dict[str, DataFrame], path: str) -> None:
    """Writes relations under path. A snapshot whose list is missing was not finished."""
    spark = next(iter(relations.values())).sparkSession
    for name, relation in relations.items():
        relation.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(sorted(relations)),)], "names string").coalesce(1).write.text(f"{path}/{LISTED}")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of a finished snapshot by name; raises where it has no list."""
    names = json.loads(spark.read.text(f"{path}/{LISTED}").first()["value"])
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
