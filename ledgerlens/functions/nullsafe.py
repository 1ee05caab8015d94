"""Null semantics of the audit recipes.

The recipes filter with ``!=`` and keep rows whose value is missing, and
their merges match a missing key with a missing key.  SQL ``!=`` and ``=``
do neither, so these helpers spell the recipe's meaning out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ne_keep_null(col: str | Column, value) -> Column:
    """``col != value`` that keeps null rows (plain ``!=`` drops them)."""
    return ~_c(col).eqNullSafe(F.lit(value))


def not_in_keep_null(col: str | Column, values) -> Column:
    """``col`` is none of ``values``; null rows are kept."""
    return reduce(lambda a, b: a & b, [ne_keep_null(col, v) for v in values])
