"""Date helpers: Monday-first week numbers, outstanding days, age buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import schemas as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def week_of_year_monday(d) -> Column:
    """Week of the year with Monday as first day, 0..53 (C ``%W``).

    Days before the year's first Monday are week 0.  ``weekofyear`` is the
    ISO week and differs around New Year.
    """
    d = _c(d)
    return F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")


def outstanding_days(balance, doc_date, as_of) -> Column:
    """0 for a settled or credit balance, else whole days since the date."""
    balance, doc_date = _c(balance), _c(doc_date)
    as_of = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    return F.when(balance <= 0, F.lit(0)).when(balance > 0, F.datediff(as_of, doc_date)).cast("int")


def age_bucket(days) -> Column:
    """Bucket label; negative (future-dated) and null days get no label."""
    days = _c(days)
    return (
        F.when((days >= 60) & (days <= 90), F.lit(S.BUCKET_60_90))
        .when((days > 90) & (days <= 120), F.lit(S.BUCKET_90_120))
        .when(days > 120, F.lit(S.BUCKET_OVER_120))
        .when((days < 60) & (days > 0), F.lit(S.BUCKET_UNDER_60))
        .when(days == 0, F.lit(S.BUCKET_NOT_OUTSTANDING))
    )
