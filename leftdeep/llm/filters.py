"""Filters of bounded size for sets of 64-bit numbers: false hits are possible, misses aren't."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each number, and 2**MOST_BITS (32 MB to each worker) at most: beyond that a filter
#: lets more through than it should, and what it saves is saved no more.
PER_NUMBER, MOST_BITS = 16, 28
U = np.uint64


def marks(numbers: DataFrame) -> np.ndarray:
    """The filter of a DataFrame of one column of longs, which are hashes already."""
    bits = min(MOST_BITS, max(16, (PER_NUMBER * numbers.count()).bit_length()))
    at = numbers.select(F.pmod(F.col(numbers.columns[0]), F.lit(1 << bits)).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), U)
    found = words.toPandas()  # 2**(MOST_BITS - 6) rows at most
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(U)
    return out


def hit(found: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each of the numbers may be in the set."""
    at = numbers.view(U) & U(len(found) * 64 - 1)
    return (found[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == U(1)


def may_hold(df: DataFrame, numbers: DataFrame) -> Callable[[Column], Column]:
    """A test for columns of longs of ``df``: whether the value may be in ``numbers``."""
    sent = df.sparkSession.sparkContext.broadcast(marks(numbers))

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(hit(sent.value, values.to_numpy(np.int64)))

    return test
