"""A fixed-size bitmap of hashes, to spare a shuffle rows that cannot join. The join itself still compares whole keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits as 64-bit words, set at the leading bits of the long ``column``; the driver gets 2**(bits - 6) words at most."""
    at = F.shiftrightunsigned(column, 64 - bits)
    got = rows.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63).cast("long")).cast("int").alias("bit"))
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for r in got.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("v")).collect():
        words[r["word"]] = r["v"] & 0xFFFFFFFFFFFFFFFF
    return words


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for the unsigned 64-bit ``hashes`` whose bit is set."""
    at = hashes >> np.uint64(64 - (len(words).bit_length() - 1 + 6))
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
