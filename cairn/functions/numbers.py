"""Numbers as the collections hold them: text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strict_int(text: Column) -> Column:
    """A signed 64-bit integer, or null for anything else, blanks included."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def strict_float(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


@F.pandas_udf(StringType())
def float_text(x: pd.Series) -> pd.Series:
    """Shortest decimal that reads back as the same number, without exponent. For presentation only."""
    return x.map(lambda v: None if pd.isna(v) else np.format_float_positional(v, trim="-"))


def add(a: Column, b: Column) -> Column:
    """Null where the sum leaves 64 bits."""
    return F.try_add(a, b)
