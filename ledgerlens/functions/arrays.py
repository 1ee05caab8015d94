"""Functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_consec(values: str | Column) -> Column:
    """Lengths of the runs of consecutive numbers in an array, in order, as array<int>.

    A run goes on while an element is the one before plus 1.  Fixed values, the
    worked example: [1, 4, 5, 6, 7, 9, 19, 21, 22, 23, 24] gives [1, 4, 1, 1, 4].
    A null element is a run of its own; an empty array gives [1], as the
    original does, and a null array null.  Native and linear in the array's
    length: the places where runs begin, then their differences.
    """
    a = _c(values)
    n = F.size(a)
    follows = lambda i: F.coalesce(F.get(a, i) == F.try_add(F.get(a, i - 1), F.lit(1)), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~follows(i))
    # The next start, or behind the last run the end.
    lengths = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda here, there: F.coalesce(there, n) - here)
    return F.when(n == 0, F.array(F.lit(1))).when(a.isNotNull(), lengths)


def list_text(values: str | Column) -> Column:
    """An array as the text ``[1, 4, 5]``, the form in which reports in CSV files hold lists."""
    return F.concat(F.lit("["), F.array_join(_c(values), ", ", "null"), F.lit("]"))
