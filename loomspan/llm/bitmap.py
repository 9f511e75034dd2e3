"""A bounded membership filter: a bitmap of fixed size, built and tested by Spark's own functions.

The bitmap has 2**bits places however many keys there are, so its broadcast is
bounded by construction (2 MB for 24 bits).  It lets false positives through;
callers follow it with an exact join or check, so it saves work and decides nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row's bitmap: what bitmap_construct_agg makes.
_ROW_BITS = 15


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def build(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, bitmap), at most 2**(bits-15) rows of 4 kB."""
    return of_places(keys.select(_place(F.col(key), bits).alias("p")))


def of_places(places: DataFrame) -> DataFrame:
    """(bucket, bitmap) of places that are given as column p."""
    return places.groupBy(F.shiftright("p", _ROW_BITS).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << _ROW_BITS) - 1)).alias("_bitmap"))


def keep(df: DataFrame, key: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """Rows of df whose key may be in the bitmap; no row whose key is in it is lost."""
    place = _place(F.col(key), bits)
    low = place.bitwiseAND((1 << _ROW_BITS) - 1)
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright(low, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, low.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    return df.withColumn("_b", F.shiftright(place, _ROW_BITS)).join(
        F.broadcast(bitmap.withColumnRenamed("_bucket", "_b")), "_b").where(hit).drop("_b", "_bitmap")


def to_numpy(bitmap: DataFrame, bits: int) -> np.ndarray:
    """The bitmap as bytes (2**bits / 8), for workers that test it in numpy; bounded by bits."""
    out = np.zeros((1 << (bits - _ROW_BITS), 1 << (_ROW_BITS - 3)), np.uint8)
    for row in bitmap.toLocalIterator():
        out[row["_bucket"]] = np.frombuffer(row["_bitmap"], np.uint8)
    return out.reshape(-1)
