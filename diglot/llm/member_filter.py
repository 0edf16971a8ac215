"""A bit filter of ids with a fixed size, to keep rows without a partner out of a shuffle.

The filter has 2**26 bits (8 MB) whatever the number of ids, so it may be broadcast. It never misses an
id; the more ids there are, the more other rows pass, and those only cost their shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def _place(ids: Column) -> Column:
    """From 1 to BITS."""
    return F.pmod(F.xxhash64(ids.cast("long")), F.lit(BITS)) + 1


def maybe_in(ids: DataFrame, column: str):
    """A function from a column of ids to a boolean column: false only for ids that aren't in ids[column].

    The bits are set in maps of 4 KB on the executors; the driver gathers at most 8 MB.
    """
    spark = ids.sparkSession
    place = ids.select(_place(F.col(column)).alias("p"))
    maps = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in maps.collect():
        # map b holds the places from 32768 * (b - 1) + 1 on
        at = (r.b - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(place: pd.Series) -> pd.Series:
        p = place.fillna(1).to_numpy(np.int64) - 1
        return pd.Series((sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: F.when(c.isNull(), F.lit(False)).otherwise(test(_place(c)))
