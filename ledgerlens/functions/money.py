"""Money columns: exact decimals, sums that treat "nothing" as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schemas import MONEY, TOTAL


def money(col) -> Column:
    """Cast to the library's money type, decimal(18,2)."""
    col = F.col(col) if isinstance(col, str) else col
    return col.cast(MONEY)


def sum0(col) -> Column:
    """Sum that is 0 (not null) over no rows or only null values."""
    col = F.col(col) if isinstance(col, str) else col
    return total(F.coalesce(F.sum(col), F.lit(0)))


def total(col: Column) -> Column:
    """Cast to the type of totals, decimal(28,2): ten digits wider than the amounts, as sums are."""
    return col.cast(TOTAL)
