"""Property tests: the Spark forms equal the definitions of their results on
random frames with missing values."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

from helpers import inv, invoices, pairs
from pyspark.sql import types as T

from ledgerlens import schemas as S
from ledgerlens.operators import payables as P
from ledgerlens.operators import receivables as R

TRIALS = 6


def _rand_rows(rnd, n):
    vendors = ["A", "B", "C", None]
    refs = ["1", "2", "3", None]
    types = ["RE", "ZP", "KZ", None]
    rows = []
    for _ in range(n):
        rows.append(
            inv(
                rnd.choice(vendors), rnd.choice(refs), doc=rnd.choice(["D1", "D2"]),
                doc_type=rnd.choice(types), amt=rnd.choice(["1.00", "2.00"]),
            )
        )
    # some exact duplicate lines
    rows += [rnd.choice(rows) for _ in range(n // 4)]
    return rows


def _by_definition(rows, history):
    """Task 1 and the payment mix from what they mean: a vendor has PO-backed lines, others, or both."""
    vendor, ref, kind = 2, 7, 5
    lines = [r for r in rows if r[kind] not in S.PAYMENT_DOC_TYPES]
    backed = {r: (r[vendor], r[ref]) in set(history) for r in lines}
    with_po = {r[vendor] for r in lines if backed[r]}
    without_po = {r[vendor] for r in lines if not backed[r]}
    both = with_po & without_po
    mix = Counter((r, "both_sundry" if r[vendor] in both else "only_sundry") for r in lines if not backed[r])
    mix += Counter((r, "both_po" if r[vendor] in both else "only_po") for r in set(lines) if backed[r])
    return [r for r in lines if r[vendor] in both], mix


def test_both_ways_and_mix_equal_their_definition(spark):
    rnd = random.Random(2024)
    for trial in range(TRIALS):
        rows = _rand_rows(rnd, rnd.randint(5, 40))
        hist = [(rnd.choice(["A", "B", "C", None]), rnd.choice(["1", "2", "3", None])) for _ in range(rnd.randint(0, 5))]
        hist = hist or [("none", "none")]
        task1, mix = _by_definition(rows, hist)
        elig = P.eligible_invoices(invoices(spark, rows))
        h = pairs(spark, hist)
        got1 = Counter(tuple(r) for r in P.vendors_paid_both_ways(elig, h).collect())
        idx = [0, 1, 2, 9, 12, 10, 11, 3, 6, 5, 7]  # TASK1_COLUMNS positions in the input tuple
        exp1 = Counter(tuple(r[i] for i in idx) for r in task1)
        assert got1 == exp1, trial
        got_mix = Counter((tuple(r[:-1]), r[-1]) for r in P.invoice_payment_mix(elig, h).collect())
        assert got_mix == mix, trial


BSID = T.StructType(
    [
        T.StructField(S.COMPANY, T.StringType()),
        T.StructField(S.CUST, T.StringType()),
        T.StructField(S.REF, T.StringType()),
        T.StructField(S.IND, T.StringType()),
        T.StructField(S.AMT_LOC, S.MONEY),
        T.StructField(S.DOC_DATE, T.DateType()),
    ]
)


def _balances_by_definition(items, knkk, as_of):
    """Per key: signed sums times the customer's credit areas, the earliest date of all items, days open."""
    out = {}
    for key in {(i[1], i[2]) for i in items if i[1] is not None and i[2] is not None}:
        own = [i for i in items if (i[1], i[2]) == key]
        if not any(i[3] in ("S", "H") for i in own):
            continue
        areas = max(1, knkk.count(key[0]))
        debit, credit = (areas * sum((i[4] or Decimal(0) for i in own if i[3] == k), Decimal(0)) for k in "SH")
        date = min((i[5] for i in own if i[5] is not None), default=None)
        days = 0 if debit <= credit else (as_of - date).days if date else None
        out[key] = (debit, credit, debit - credit, date, days)
    return out


def test_balances_equal_their_definition(spark):
    rnd = random.Random(99)
    as_of = dt.date(2018, 12, 1)
    for trial in range(TRIALS):
        items = [
            (
                "10", rnd.choice(["C1", "C2", "C3", None]), rnd.choice(["R1", "R2", None]),
                rnd.choice(["S", "H", "X", None]), rnd.choice([Decimal("5.00"), Decimal("7.50"), None]),
                rnd.choice([dt.date(2018, 1, 1), dt.date(2018, 10, 1), dt.date(2019, 1, 1), None]),
            )
            for _ in range(rnd.randint(1, 30))
        ]
        knkk = [rnd.choice(["C1", "C2"]) for _ in range(rnd.randint(0, 4))]
        exp = _balances_by_definition(items, knkk, as_of)
        kdf = spark.createDataFrame([(k, "US01", Decimal("1.00")) for k in knkk] or [("none", None, None)],
                                    f"`{S.CUST}` string, `{S.AREA}` string, `{S.LIMIT}` decimal(18,2)")
        got = R.document_balances(spark.createDataFrame(items, BSID), kdf, as_of=as_of).collect()
        got = {(r[S.CUST], r[S.REF]): (r.Amount_S, r.Amount_H, r.Balance, r[S.DOC_DATE], r.outstanding_days) for r in got}
        assert got == exp, trial
