"""Order-preserving integers of floating-point numbers, and registered scalar functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def ordered_long(x: pd.Series) -> pd.Series:
    """A long that sorts like the double: the sign bit stays, a negative number's other bits flip."""
    bits = x.to_numpy(np.float64).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def from_ordered_long(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def register(spark: SparkSession) -> None:
    """SQL functions add(i, j), ordered_long and from_ordered_long."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION add(i INT, j INT) RETURNS INT RETURN i + j")
    spark.udf.register("ordered_long", ordered_long)
    spark.udf.register("from_ordered_long", from_ordered_long)
