"""Overlapping windows over token sequences, and how sites are shared out among them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, OVERLAP = 256, 16


def starts(length: Column, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """First tokens of the windows of a sequence."""
    return F.when(length <= 2 * overlap, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), length - 2 * overlap - 1, F.lit(chunk - 2 * overlap)))


def owner(pos: Column, length: Column, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """The one window that owns a token: the middle of each, the first and last reaching to the ends."""
    gap = chunk - 2 * overlap
    last = F.greatest(F.ceil((length - 2 * overlap) / gap) - 1, F.lit(0))
    return F.when(pos < gap + overlap, 0).otherwise(F.least(F.floor((pos - overlap) / gap), last)).cast("int")


def length_bin(n: Column, *, width: int = 500) -> Column:
    return F.floor(n / width).cast("int")
