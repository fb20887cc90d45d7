"""Tables of hash bits of a fixed size: small enough to broadcast, whatever they stand for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one row of Spark's bitmap functions.
_ROW = 8 * 4096


def bits_of(df: DataFrame, column: str, size: int) -> np.ndarray:
    """Bits set at every value of ``column``, a place from 0 to ``size`` - 1, as bytes.

    Spark builds rows of 4 KB and merges them before and after the shuffle; what comes
    to the driver is ``size`` / 8 bytes at most. Nulls set nothing.
    """
    place = F.col(column).cast("bigint") + 1
    rows = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.bitmap_bucket_number(place).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )
    out = np.zeros(-(-size // _ROW) * _ROW // 8, np.uint8)
    for part, bits in rows.collect():
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(bits, np.uint8)
    return out[: size // 8]
