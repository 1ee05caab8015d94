"""Hot keys and the end-to-end batch plans."""

import datetime as dt
from collections import Counter

from helpers import inv, invoices, pairs

import __spark_entry__ as E
from conftest import SF_SMALL
from ledgerlens import schemas as S
from ledgerlens.operators import payables as P
from ledgerlens.plans import batch
from ledgerlens.sources import testviews as tv

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


def test_hot_vendor_is_split_and_results_are_whole(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        rows = [inv("HOT", str(i % 7), doc=f"H{i}", date=dt.date(2018, 1, 1)) for i in range(3000)]
        rows += [inv(f"V{j}", str(j % 5), doc=f"D{j}") for j in range(6000)]
        elig = invoices(spark, rows).repartition(8)
        hist = pairs(spark, [("HOT", "1"), ("HOT", "2")] + [(f"V{j}", "0") for j in range(0, 6000, 3)])
        out = P.vendors_paid_both_ways(elig, hist)
        counts = {}
        for r in out.collect():
            counts[r[S.VENDOR]] = counts.get(r[S.VENDOR], 0) + 1
        assert counts["HOT"] == 3000  # every line of the hot vendor, none dropped
        expected = {f"V{j}" for j in range(0, 6000, 3) if j % 5 != 0}
        assert {v for v in counts if v != "HOT"} == set()  # V vendors have one line each: not both ways
        assert expected  # sanity: they are PO-only or sundry-only
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "isSkew=true" in plan or "skew=true" in plan, plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_and_null_po_items_are_split(spark):
    """po_file with one hot PO item and a null one: all pairs, and joins whose skew is split."""
    from ledgerlens.operators import enrich

    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        keys = f"`{S.PO_NUM}` string, `{S.PO_ITEM}` string"
        receipts = [("HOT", "1", f"r{i}") for i in range(2500)] + [(f"P{i}", "1", f"p{i}") for i in range(3000)] + [(None, None, "rn")]
        history = [("HOT", "1", "h1"), ("HOT", "1", "h2"), (None, None, "hn"), (None, None, "hm"), ("ONLY", "1", "h3")]
        rseg = spark.createDataFrame(receipts, keys + ", rec string").repartition(8)
        ekpo = spark.createDataFrame([("HOT", "1"), ("LINE", "1")], keys)
        ekbe = spark.createDataFrame(history + [(f"P{i}", "1", "h") for i in range(0, 3000, 2)], keys + ", hist string").repartition(8)
        out = enrich.po_file(rseg, ekpo, ekbe)
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == 5000 + 3000 + 2 + 2  # hot x 2, the others once, null x null, LINE and ONLY
        assert sum(r[0] is None for r in rows) == 2
        assert ("ONLY", "1", None, "h3") in rows and ("LINE", "1", None, None) in rows
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FullOuter" not in plan and "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(df):
    columns = sorted(df.columns)
    return Counter(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_batch_reports_match_registered_queries(spark, tmp_dir):
    d, q = SF_SMALL, E.queries()
    inputs = lambda variant: batch.PayablesInputs(
        bsak=tv.bsak(spark, d, variant), lfa1=tv.lfa1(spark, d, variant), t001=tv.t001(spark, d),
        ekbe=tv.ekbe_pairs(spark, d, variant),
    )
    for variant, names in (
        ("part", {"task1": "vendors_paid_both_ways", "task2": "invoice_frequency", "invoice_file_type": "invoice_payment_mix"}),
        ("supp", {"task3": "recurring_sundry", "recur_invoice": "recurrence_profile", "recur_weeks": "consecutive_run_lengths"}),
        ("cust", {"task4": "one_time_vendor_invoices", "one_time_vendors_invoices": "single_document_vendor_invoices"}),
    ):
        reports = batch.payables_reports(inputs(variant))
        for report, name in names.items():
            assert _rows(reports[report]) == _rows(q[name](spark, d)), report
    rin = batch.ReceivablesInputs(bsid=tv.bsid(spark, d), knkk=tv.knkk(spark, d), t001=tv.t001(spark, d))
    ar = batch.receivables_reports(rin, as_of=tv.AS_OF)
    assert _rows(ar["balance_amount"]) == _rows(q["credit_limit_status"](spark, d))
    assert _rows(ar["task5"]) == _rows(q["ar_aging_by_customer"](spark, d))
    paths = batch.run_reports({"task5": ar["task5"]}, tmp_dir)
    back = spark.read.option("header", True).csv(paths["task5"])
    assert back.columns == S.TASK5_COLUMNS and back.count() == ar["task5"].count()
