import datetime as dt
from decimal import Decimal

from helpers import inv, invoices, pairs

from ledgerlens import schemas as S
from ledgerlens.operators import payables as P


def _mix_input(spark):
    rows = [
        inv("A", "1", doc="D1"), inv("A", "1", doc="D1"),
        inv("A", "7", doc="D2"), inv("A", "7", doc="D2"),
        inv("B", "2", doc="D3"),
        inv("C", "2", doc="D4"),
        inv(None, "9", doc="D5"),
        inv("C", "5", doc="D6", doc_type=None),
        inv("B", "3", doc="D7", doc_type="ZP"),
    ]
    hist = pairs(spark, [("A", "1"), ("B", "2"), (None, "9")])
    return P.eligible_invoices(invoices(spark, rows)), hist


def test_payment_mix_golden(spark):
    eligible, hist = _mix_input(spark)
    out = P.invoice_payment_mix(eligible, hist).collect()
    got = sorted((r[S.VENDOR] or "-", r[S.REF], r["type"]) for r in out)
    assert got == sorted(
        [
            ("A", "1", "both_po"),
            ("A", "7", "both_sundry"), ("A", "7", "both_sundry"),
            ("B", "2", "only_po"),
            ("C", "2", "only_sundry"),
            ("-", "9", "only_po"),
            ("C", "5", "only_sundry"),
        ]
    )


def test_vendors_paid_both_ways_returns_all_rows_of_vendor_a(spark):
    eligible, hist = _mix_input(spark)
    out = P.vendors_paid_both_ways(eligible, hist)
    assert out.columns == S.TASK1_COLUMNS
    got = sorted((r[S.VENDOR], r[S.REF]) for r in out.collect())
    assert got == [("A", "1"), ("A", "1"), ("A", "7"), ("A", "7")]


def test_po_paid_distinct_and_sundry_keeps_duplicates(spark):
    eligible, hist = _mix_input(spark)
    assert P.po_paid_invoices(eligible, hist).count() == 3  # (A,1) once, (B,2), (null,9)
    sundry = sorted((r[S.VENDOR], r[S.REF]) for r in P.sundry_invoices(eligible, hist).collect())
    assert sundry == [("A", "7"), ("A", "7"), ("C", "2"), ("C", "5")]


def test_po_pairs_null_pair_from_lines_without_history(spark):
    from pyspark.sql import types as T

    keys = T.StructType([T.StructField(S.PO_NUM, T.StringType()), T.StructField(S.PO_ITEM, T.StringType())])
    ekbe_schema = T.StructType(keys.fields + [T.StructField(S.PO_VENDOR, T.StringType()), T.StructField(S.REF, T.StringType())])
    ekbe = spark.createDataFrame([("P1", "10", "A", "1")], ekbe_schema)
    rseg = spark.createDataFrame([("P1", "10"), ("P2", "20")], keys)  # P2 has no history
    got = {tuple(r) for r in P.po_pairs(ekbe, rseg=rseg).collect()}
    assert got == {("A", "1"), (None, None)}
    assert {tuple(r) for r in P.po_pairs(ekbe).collect()} == {("A", "1")}
    # an invoice with neither vendor nor reference is then PO-paid
    elig = invoices(spark, [inv(None, None), inv("A", "1")])
    assert P.sundry_invoices(elig, P.po_pairs(ekbe, rseg=rseg)).count() == 0
    assert P.sundry_invoices(elig, P.po_pairs(ekbe)).count() == 1


def test_invoice_frequency_ignores_null_vendor(spark):
    rows = [inv("A", "1", doc="D1"), inv("A", "1", doc="D1", line=2), inv("A", "2", doc="D2"), inv(None, "3", doc="D9")]
    got = {r[S.VENDOR]: r.Invoice_Frequency for r in P.invoice_frequency(invoices(spark, rows)).collect()}
    assert got == {"A": 2}


def test_document_totals_and_recurring(spark):
    d1, d2 = dt.date(2018, 1, 1), dt.date(2018, 2, 1)
    rows = [
        inv("A", "1", doc="D1", date=d1, amt="5.00"), inv("A", "1", doc="D1", line=2, date=d1, amt="5.00"),
        inv("A", "2", doc="D2", date=d2, amt="10.00"),          # same total 10 as D1 -> recurring
        inv("A", "3", doc="D3", date=d2, amt="7.00"),           # unique amount
        inv("B", "4", doc="D4", date=d1, amt=None),             # all-null sum is 0
        inv("B", "5", doc="D5", date=d2, amt=None),             # ... twice -> recurring
    ]
    sundry = invoices(spark, rows)
    totals = {(r[S.VENDOR], r[S.DOC]): r[S.AMT_DOC] for r in P.sundry_document_totals(sundry).collect()}
    assert totals == {("A", "D1"): Decimal("10.00"), ("A", "D2"): Decimal("10.00"),
                      ("A", "D3"): Decimal("7.00"), ("B", "D4"): Decimal("0.00"), ("B", "D5"): Decimal("0.00")}
    rec = P.recurring_sundry(sundry)
    assert rec.columns == S.TASK3_COLUMNS
    assert sorted((r[S.VENDOR], r[S.DOC], r[S.REF]) for r in rec.collect()) == [
        ("A", "D1", "1"), ("A", "D2", "2"), ("B", "D4", "4"), ("B", "D5", "5")
    ]


def test_attributes_joined_without_date(spark):
    # one document with two dates: each dated total gets the attributes of both lines
    rows = [
        inv("A", "1", doc="D1", date=dt.date(2018, 1, 1), amt="3.00"),
        inv("A", "2", doc="D1", date=dt.date(2018, 1, 8), amt="3.00"),
    ]
    rec = P.recurring_sundry(invoices(spark, rows)).collect()
    assert len(rec) == 4


def test_recurrence_profile_weeks_and_months(spark):
    days = [dt.date(2018, 1, 1), dt.date(2018, 1, 8), dt.date(2018, 1, 15), dt.date(2018, 3, 5)]
    rows = [inv("A", str(i), doc=f"{i + 1}", date=d, amt="9.00") for i, d in enumerate(days)]
    prof = P.recurrence_profile(invoices(spark, rows)).collect()
    assert len(prof) == 4
    r = prof[0]
    assert (r.times, r.month_count, r.run_count, r.max_consecutive_weeks) == (4, 2, 2, 3)
    assert sorted(x.week for x in prof) == [1, 2, 3, 10]
    assert sorted(x.position for x in prof) == [1, 2, 3, 4]


def test_document_order_is_numeric(spark):
    # documents 9 and 10: numeric order puts 9 first, so weeks 1 -> 2 is one run
    rows = [
        inv("A", "1", doc="10", date=dt.date(2018, 1, 8), amt="4.00"),
        inv("A", "2", doc="9", date=dt.date(2018, 1, 1), amt="4.00"),
    ]
    runs = P.consecutive_run_lengths(invoices(spark, rows)).collect()
    assert [(r.run_index, r.run_length, r.first_week) for r in runs] == [(1, 2, 1)]


def test_one_time_and_single_document_vendors(spark):
    rows = [
        inv("ONE", "1", doc="D1", line=1), inv("ONE", "1", doc="D1", line=1),     # duplicates collapse
        inv("TWOLINES", "1", doc="D2", line=1), inv("TWOLINES", "1", doc="D2", line=2),
        inv("TWODOCS", "1", doc="D3"), inv("TWODOCS", "1", doc="D4"),
        inv(None, "1", doc="D5"),
    ]
    elig = invoices(spark, rows)
    one = P.one_time_vendor_invoices(elig)
    assert one.columns == S.TASK4_COLUMNS
    assert [r[S.VENDOR] for r in one.collect()] == ["ONE"]
    single = P.single_document_vendor_invoices(elig)
    assert single.columns == S.SINGLE_DOC_COLUMNS
    # the two TWOLINES lines differ only in the line number, which O15 does not report
    assert sorted(r[S.VENDOR] for r in single.collect()) == ["ONE", "TWOLINES"]


def test_week_order_and_absolute_options(spark):
    # documents out of week order, with a repeat and a year change
    rows = [
        inv("A", "1", doc="1", date=dt.date(2018, 1, 15), amt="2.00"),   # week 3
        inv("A", "2", doc="2", date=dt.date(2018, 1, 8), amt="2.00"),    # week 2
        inv("A", "3", doc="3", date=dt.date(2018, 1, 1), amt="2.00"),    # week 1
        inv("A", "4", doc="4", date=dt.date(2018, 1, 2), amt="2.00"),    # week 1 again
        inv("A", "5", doc="5", date=dt.date(2018, 12, 31), amt="2.00"),  # week 53
        inv("A", "6", doc="6", date=dt.date(2019, 1, 7), amt="2.00"),    # week 1 of 2019
    ]
    sundry = invoices(spark, rows)
    doc = [r.run_length for r in sorted(P.consecutive_run_lengths(sundry).collect(), key=lambda r: r.run_index)]
    assert doc == [1, 1, 1, 1, 1, 1]
    week = [r.run_length for r in sorted(P.consecutive_run_lengths(sundry, order="week").collect(), key=lambda r: r.run_index)]
    assert week == [3, 1]                    # distinct weeks 1,2,3 then 53
    absw = P.consecutive_run_lengths(sundry, order="week", absolute=True).collect()
    # absolute weeks do not wrap: 2018-12-31 and 2019-01-07 are consecutive weeks
    assert sorted(r.run_length for r in absw) == [2, 3]
    prof = P.recurrence_profile(sundry, order="week").collect()
    assert len(prof) == 6 and {r.times for r in prof} == {6}
