"""Accounts-receivable analytics (O17 balances, O18 aging, O19 credit limits).

Balances are one ``groupBy(customer, reference)`` with conditional sums and
the earliest date (partial aggregation), instead of two group-bys, an outer
join and a self-join.

Credit-area fan-out: the original joins every open item to each of its
customer's credit areas *before* summing, so a customer with k areas has its
balances multiplied by k.  That is the default (``fan_out=True``); since
the factor is constant per customer it is applied after aggregating, by
joining the per-customer area count onto the (much smaller) balances, not by
multiplying the open items.  ``fan_out=False`` gives the plain sums.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.dates import age_bucket, outstanding_days
from ledgerlens.functions.joins import nullsafe_join
from ledgerlens.functions.money import sum0, total
from ledgerlens.functions.nullsafe import ne_keep_null
from ledgerlens.session import materialize

BALANCE_COLUMNS = [
    S.CUST,
    S.REF,
    "Amount_S",
    "Amount_H",
    "Balance",
    S.DOC_DATE,
    "outstanding_days",
    "type",
]


def _credit_multiplicity(knkk: DataFrame) -> DataFrame:
    return knkk.where(F.col(S.CUST).isNotNull()).groupBy(S.CUST).agg(F.count(F.lit(1)).alias("_areas"))


def _item_sums(bsid: DataFrame, *more: str) -> DataFrame:
    """Debit and credit sums, whether there is an S or H item, and the earliest date, per (customer, reference, more)."""
    ind, amt = F.col(S.IND), F.col(S.AMT_LOC)
    return bsid.groupBy(S.CUST, S.REF, *more).agg(
        F.sum(F.when(ind == S.DEBIT, amt)).alias("_s"),
        F.sum(F.when(ind == S.CREDIT, amt)).alias("_h"),
        F.max((ind == S.DEBIT) | (ind == S.CREDIT)).alias("_sh"),
        F.min(S.DOC_DATE).alias(S.DOC_DATE),
    )


def _balances(sums: DataFrame, knkk: DataFrame | None, as_of: _dt.date | str, fan_out: bool) -> DataFrame:
    """O17 from sums per (customer, reference)."""
    agg = sums.where(F.col(S.CUST).isNotNull() & F.col(S.REF).isNotNull() & F.col("_sh"))
    if fan_out and knkk is not None:
        agg = agg.join(_credit_multiplicity(knkk), S.CUST, "left")
        k = F.coalesce(F.col("_areas"), F.lit(1))
    else:
        k = F.lit(1)
    out = (
        agg.withColumn("Amount_S", total(F.coalesce(F.col("_s"), F.lit(0)) * k))
        .withColumn("Amount_H", total(F.coalesce(F.col("_h"), F.lit(0)) * k))
        .withColumn("Balance", total(F.col("Amount_S") - F.col("Amount_H")))
        .withColumn("outstanding_days", outstanding_days("Balance", S.DOC_DATE, as_of))
        .withColumn("type", age_bucket("outstanding_days"))
    )
    return out.select(BALANCE_COLUMNS)


def document_balances(
    bsid: DataFrame,
    knkk: DataFrame | None = None,
    *,
    as_of: _dt.date | str,
    fan_out: bool = True,
) -> DataFrame:
    """Per (customer, reference) debit and credit sums, balance, earliest
    date, outstanding days and age bucket.

    A key gets a row only if it has a debit (S) or credit (H) item; its date
    is the earliest over all its items.  ``as_of`` is the aging date (a
    parameter, so results are reproducible).
    """
    return _balances(_item_sums(bsid), knkk, as_of, fan_out)


def ar_aging_by_customer(
    bsid: DataFrame,
    knkk: DataFrame,
    t001: DataFrame,
    *,
    as_of: _dt.date | str,
    fan_out: bool = True,
    excluded_area: str = "CAN",
) -> DataFrame:
    """O18 (Task 5): per customer, balances 60-90, 90-120, over 120 days and
    their total, repeated for each of the customer's (company, credit limit,
    area) combinations; area ``CAN`` removed, a missing area kept.
    """
    # The items are read once: their sums per (customer, reference, company) are written, and give both
    # the balances and the companies of a customer.
    parts = materialize(_item_sums(bsid.where(F.col(S.CUST).isNotNull()), S.COMPANY), "item-sums")
    sums = parts.groupBy(S.CUST, S.REF).agg(
        F.sum("_s").alias("_s"), F.sum("_h").alias("_h"), F.max("_sh").alias("_sh"), F.min(S.DOC_DATE).alias(S.DOC_DATE)
    )
    bal = _balances(sums, knkk, as_of, fan_out)
    t = F.col("type")
    bal_col = F.col("Balance")
    by_cust = (
        bal.where(t.isin(*S.OVERDUE_BUCKETS))
        .groupBy(S.CUST)
        .agg(
            sum0(F.when(t == S.BUCKET_60_90, bal_col)).alias("Local_Amount_60-90_Days"),
            sum0(F.when(t == S.BUCKET_90_120, bal_col)).alias("Local_Amount_90-120_Days"),
            sum0(F.when(t == S.BUCKET_OVER_120, bal_col)).alias("Local_Amount_>120_Days"),
            sum0(bal_col).alias("Total_Amount_Local_Currency"),
        )
    )
    pairs = parts.select(S.CUST, S.COMPANY).distinct()
    attrs = nullsafe_join(pairs, knkk.select(S.CUST, S.LIMIT, S.AREA), [S.CUST], "left")
    attrs = nullsafe_join(
        attrs, t001.select(S.COMPANY, S.COMPANY_NAME, S.LOC_CUR), [S.COMPANY], "left"
    ).select(S.CUST, S.COMPANY, S.COMPANY_NAME, S.LOC_CUR, S.LIMIT, S.AREA).distinct()
    return (
        by_cust.join(attrs, S.CUST, "left")
        .where(ne_keep_null(S.AREA, excluded_area))
        .select(S.TASK5_COLUMNS)
    )


def credit_limit_status(
    bsid: DataFrame,
    knkk: DataFrame,
    *,
    as_of: _dt.date | str,
    fan_out: bool = True,
) -> DataFrame:
    """Each document balance against each credit limit of its customer:
    ``above limit`` / ``below limit``, and ``no limit`` when the limit is missing.
    """
    bal = document_balances(bsid, knkk, as_of=as_of, fan_out=fan_out)
    limits = knkk.select(S.CUST, S.AREA, S.LIMIT)
    out = nullsafe_join(bal, limits, [S.CUST], "left")
    b, lim = F.col("Balance"), F.col(S.LIMIT)
    label = (
        F.when(b > lim, F.lit(S.ABOVE_LIMIT))
        .when(b <= lim, F.lit(S.BELOW_LIMIT))
        .otherwise(F.lit(S.NO_LIMIT))
    )
    return out.withColumn("above_limit", label)
