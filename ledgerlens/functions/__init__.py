"""Column-level helpers: null semantics, dates, money, join strategy."""

from ledgerlens.functions.dates import age_bucket, outstanding_days, week_of_year_monday
from ledgerlens.functions.joins import full_outer_nullsafe, nullsafe_join
from ledgerlens.functions.money import money, sum0
from ledgerlens.functions.nullsafe import ne_keep_null, not_in_keep_null

__all__ = [
    "age_bucket",
    "full_outer_nullsafe",
    "money",
    "ne_keep_null",
    "not_in_keep_null",
    "nullsafe_join",
    "outstanding_days",
    "sum0",
    "week_of_year_monday",
]
