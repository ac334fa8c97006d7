"""A bit table of long keys: a filter of fixed size, whatever the number of keys.

It lets through every key it was made of and, by chance, others; what it decides must be made exact afterwards. Keys
must be well mixed, their top bits choose the bit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

BITS = 24  # 2 MB


def bit_table(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The table as words of 64 bits; at most 2**(bits - 6) rows come to the driver."""
    slot = F.shiftrightunsigned(column, 64 - bits)
    word = F.shiftright(slot, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = rows.toPandas()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def in_table(table: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    slot = keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def passes(table: np.ndarray, key: Column) -> Column:
    @F.pandas_udf(BooleanType())
    def passed(keys: pd.Series) -> pd.Series:
        return pd.Series(in_table(table, keys.to_numpy(dtype=np.int64)))

    return passed(key)
