"""64-bit interleaved codes of points (longitude first), their base-32 text, cells around a point, and distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

# Radius of the earth in metres, half its circumference in the map projection, the base-32 alphabet.
EARTH_RADIUS = 6372797.560856
MERCATOR_MAX = 20037726.37
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _halved(x: np.ndarray, low: float, high: float, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `bits` binary choices between the halves of [low, high], and the interval that is left."""
    a, b = np.full(len(x), low), np.full(len(x), high)
    code = np.zeros(len(x), np.uint64)
    for _ in range(bits):
        middle = (a + b) / 2
        up = x >= middle
        a, b = np.where(up, middle, a), np.where(up, b, middle)
        code = (code << np.uint64(1)) | up.astype(np.uint64)
    return code, a, b


def encode(lng: np.ndarray, lat: np.ndarray, precision: int = 64) -> tuple[np.ndarray, tuple]:
    """Codes whose first `precision` bits alternate between longitude and latitude, and the cells' bounds."""
    across, down = (precision + 1) // 2, precision // 2
    x, x0, x1 = _halved(np.asarray(lng, float), -180.0, 180.0, across)
    y, y0, y1 = _halved(np.asarray(lat, float), -90.0, 90.0, down)
    code = np.zeros(len(x), np.uint64)
    for k in range(precision):
        source, width = (x, across) if k % 2 == 0 else (y, down)
        code |= ((source >> np.uint64(width - 1 - k // 2)) & np.uint64(1)) << np.uint64(63 - k)
    return code, (x0, x1, y0, y1)


def decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of the cells' centres."""
    out = []
    for first, low, high in ((0, -180.0, 180.0), (1, -90.0, 90.0)):
        a, b = np.full(len(code), low), np.full(len(code), high)
        for k in range(32):
            up = ((code >> np.uint64(63 - 2 * k - first)) & np.uint64(1)).astype(bool)
            middle = (a + b) / 2
            a, b = np.where(up, middle, a), np.where(up, b, middle)
        out.append((a + b) / 2)
    return out[0], out[1]


def _codes(score: pd.Series) -> np.ndarray:
    return score.to_numpy(float).astype(np.uint64)


@F.pandas_udf(DoubleType())
def score_of(lng: pd.Series, lat: pd.Series) -> pd.Series:
    """The code as a sorted set holds it: a double, so bits below the 53rd may be lost."""
    return pd.Series(encode(lng.to_numpy(), lat.to_numpy())[0].astype(np.float64))


@F.pandas_udf(StructType().add("lng", DoubleType()).add("lat", DoubleType()))
def position_of(score: pd.Series) -> pd.DataFrame:
    lng, lat = decode(_codes(score))
    return pd.DataFrame({"lng": lng, "lat": lat})


@F.pandas_udf(StringType())
def text_of(score: pd.Series) -> pd.Series:
    """13 letters: 64 bits in groups of five, the last filled with a zero."""
    codes = _codes(score)
    return pd.Series(["".join(ALPHABET[int(c) >> (59 - 5 * k) & 31] if k < 12 else ALPHABET[int(c) << 1 & 31] for k in range(13)) for c in codes])


def precision_for(radius: float, latitude: float) -> int:
    """Bits of cells about as wide as the radius. Halving MERCATOR_MAX k times gives a width of MERCATOR_MAX / 2**k, so k is the binary
    logarithm of their quotient, rounded up; cells of one halving less contain the circle. Near the poles, where cells narrow, one
    halving less is taken from a latitude of 66 degrees and another from 80."""
    if radius == 0:
        return 63
    narrow = int(np.searchsorted([66, 80], abs(latitude)))
    halvings = math.ceil(math.log2(MERCATOR_MAX / radius)) - 1 - narrow
    return 2 * int(np.clip(halvings, 1, 32)) - 1


def cells_around(lng: float, lat: float, radius: float) -> list[tuple[float, float]]:
    """Bounds of the scores in the 3 x 3 cells around a point, both inclusive."""
    bits = precision_for(radius, lat)
    _, (x0, x1, y0, y1) = encode(np.array([lng]), np.array([lat]), bits)
    width, height = x1[0] - x0[0], y1[0] - y0[0]
    x, y = (x0[0] + x1[0]) / 2, (y0[0] + y1[0]) / 2
    turned = lambda v: v - 360 if v > 180 else v + 360 if v < -180 else v
    xs = [turned(x - width), x, turned(x + width)]
    ys = [min(90.0, y + height), y, max(-90.0, y - height)]
    codes, _ = encode(np.repeat([xs], 3, axis=0).ravel(), np.repeat(ys, 3), bits)
    return [(float(c), float(int(c) + (1 << (64 - bits)))) for c in codes]


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres between two points."""
    a, b = F.radians(lat1), F.radians(lat2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng1) - F.radians(lng2)) / 2), 2)))
