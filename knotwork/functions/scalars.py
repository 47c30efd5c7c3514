"""Scalar helpers of graph operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(a: Column, b: Column) -> Column:
    """Two vertex ids below 2**31 as one long, the smaller in the high half."""
    return F.shiftleft(F.least(a, b), 32).bitwiseOR(F.greatest(a, b))


def unpacked(e: Column) -> Column:
    """The struct (src, dst) of a packed edge."""
    return F.struct(F.shiftright(e, 32).alias("src"), e.bitwiseAND(F.lit((1 << 32) - 1)).alias("dst"))


def sorted_three(a: Column, b: Column, c: Column) -> Column:
    return F.array_sort(F.array(a, b, c))

