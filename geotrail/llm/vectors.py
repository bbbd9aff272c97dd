"""Shared helpers of the two vector operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & finite


def nonzero(vec: Column) -> Column:
    return F.exists(vec, lambda x: x != 0)
