"""Which of 1,024 slots a key belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 1024


def hash_tag(key: Column) -> Column:
    """What stands between the first { and the first }, if both are there and something is between them; else the key."""
    a, b = F.instr(key, "{"), F.instr(key, "}")
    return F.when((a > 0) & (b > 0) & (b != a + 1), F.when(b > a, F.substring(key, a + 1, b - a - 1))).otherwise(key)


def slot(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(hash_tag(key), key).cast("binary")), F.lit(SLOTS)).cast("int")
