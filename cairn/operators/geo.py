"""Geo operators over points (key, member, lng, lat) and their codes in a sorted set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import geohash as g

UNITS = {"m": 1.0, "km": 1000.0}


def add(points: DataFrame) -> DataFrame:
    """key, member, score of points within the bounds of the globe; others are not taken."""
    inside = points.where(F.col("lng").between(-180, 180) & F.col("lat").between(-90, 90))
    return inside.select("key", "member", g.score_of("lng", "lat").alias("score"))


def position(zsets: DataFrame) -> DataFrame:
    """key, member, lng, lat: the centre of the code's cell."""
    return zsets.select("key", "member", g.position_of("score").alias("p")).select("key", "member", "p.lng", "p.lat")


def text(zsets: DataFrame) -> DataFrame:
    return zsets.select("key", "member", g.text_of("score").alias("geohash"))


def distance(points: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """pairs (key, a, b) with the distance, null where a member is missing."""
    p = points.select("key", F.col("member").alias("a"), F.col("lng").alias("x1"), F.col("lat").alias("y1"))
    q = points.select("key", F.col("member").alias("b"), F.col("lng").alias("x2"), F.col("lat").alias("y2"))
    d = g.haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) / UNITS[unit]
    return pairs.join(p, ["key", "a"], "left").join(q, ["key", "b"], "left").select(*pairs.columns, d.alias("distance"))


def cells(zsets: DataFrame, lng: float, lat: float, radius: float, unit: str = "m") -> DataFrame:
    """Members in the 3 x 3 cells around a point, without a test of distance. The ranges of scores are filters that reach the
    scan; members of overlapping cells come once."""
    near = F.lit(False)
    for a, b in g.cells_around(lng, lat, radius * UNITS[unit]):
        near = near | F.col("score").between(a, b)
    return zsets.where(near)


def radius(points: DataFrame, lng: float, lat: float, radius: float, unit: str = "m") -> DataFrame:
    """points within a distance, which is returned in metres. A band of latitudes, filtered first, spares the trigonometry."""
    metres = radius * UNITS[unit]
    band = 57.3 * metres / g.EARTH_RADIUS
    near = points.where(F.col("lat").between(lat - band, lat + band))
    return near.withColumn("distance", g.haversine(F.col("lng"), F.col("lat"), F.lit(lng), F.lit(lat))).where(F.col("distance") <= metres)


def radius_by_member(points: DataFrame, centres: DataFrame, radius: float, unit: str = "m") -> DataFrame:
    """For each of centres (key, centre): members of its key within a distance. Points meet only in equal or neighbouring bands of
    latitude as high as the radius: an equi-join on (key, band)."""
    metres = radius * UNITS[unit]
    high = 57.3 * metres / g.EARTH_RADIUS
    band = F.floor(F.col("lat") / high)
    c = centres.join(points.withColumnRenamed("member", "centre"), ["key", "centre"]).select("key", "centre", F.col("lng").alias("x"), F.col("lat").alias("y"), F.explode(F.sequence(band - 1, band + 1)).alias("band"))
    d = g.haversine(F.col("lng"), F.col("lat"), F.col("x"), F.col("y"))
    return points.withColumn("band", band).join(c, ["key", "band"]).withColumn("distance", d).where(F.col("distance") <= metres).select("key", "centre", "member", "distance")
