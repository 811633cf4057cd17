"""Helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* of a value that is computed once; written inside another lambda, an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    """The sum of an array of doubles; null for null and for an array that holds null."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
