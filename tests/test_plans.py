"""Plan shape: equi-joins (no nested loops), filters reach the scan, one
aggregation exchange for balances."""

import re

import __spark_entry__ as E

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "type" in df.columns


def test_every_query_and_oracle_registered():
    from ledgerlens.oracle_sql import oracle_sql
    from ledgerlens.plans.queries import QUERIES

    assert set(oracle_sql()) == set(QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(QUERIES) == 26


def test_po_matching_is_an_equi_join(spark):
    for name in ("po_paid_invoices", "sundry_invoices", "invoice_payment_mix", "vendors_paid_both_ways"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_doc_type_filter_pushed_to_scan(spark):
    df = E.queries()["eligible_invoices"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert scan and "l_returnflag" in scan[0] and "DataFilters" in scan[0]


def test_balances_single_aggregation_shuffle(spark):
    df = E.queries()["document_balances"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    aggs = [line for line in plan.splitlines() if "HashAggregate" in line and "Customer_Number" in line]
    # one partial + one final aggregate on (customer, reference); the credit
    # multiplicity aggregates only the credit table
    assert sum("Reference_Document_Number" in a for a in aggs) == 2


def test_runs_have_no_python(spark):
    names = "recurrence_profile consecutive_run_lengths recurrence_lists list_run_lengths repair_ragged_po_lines csv_rejects"
    for name in names.split():
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_po_lines_are_split_once(spark):
    plan = _plan(E.queries()["repair_ragged_po_lines"](spark, SF_SMALL))
    assert plan.count("regexp_extract_all(") == 1 and len(plan) < 20_000


def _scans(spark, monkeypatch, name, table):
    """Scans of a test table in all plans a query runs, those of its written intermediates included."""
    from ledgerlens import session
    from ledgerlens.operators import payables, receivables

    plans = []
    original = session.materialize

    def noted(df, label="stage"):
        plans.append(_plan(df))
        return original(df, label)

    monkeypatch.setattr(payables, "materialize", noted)
    monkeypatch.setattr(receivables, "materialize", noted)
    plans.append(_plan(E.queries()[name](spark, SF_SMALL)))
    return [line for p in plans for line in p.splitlines() if "FileScan parquet" in line and f"/{table}.parquet" in line]


def test_big_tables_are_scanned_once(spark, monkeypatch):
    for name in ("vendors_paid_both_ways", "invoice_payment_mix"):
        lines = _scans(spark, monkeypatch, name, "lineitem")
        assert len(lines) == 2, name  # invoice lines and PO history
    assert len(_scans(spark, monkeypatch, "ar_aging_by_customer", "lineitem")) == 1


def test_no_date_predicate_and_whole_views(spark, monkeypatch):
    from ledgerlens.sources import testviews as tv

    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    assert tv.bsak(spark, SF_SMALL, "part").count() == tv.bsak(spark, SF_SMALL, "supp").count() == lines.where("l_linestatus = 'O'").count()
    assert tv.bsak(spark, SF_SMALL, "cust").count() == lines.count()
    parts = tv.rseg(spark, SF_SMALL).count() + tv.ekbe(spark, SF_SMALL).count() + lines.where("l_returnflag = 'N'").count()
    assert parts == lines.count()
    for variant in ("part", "supp", "cust"):
        plan = _plan(tv.bsak(spark, SF_SMALL, variant))
        filters = " ".join(re.findall(r"(?:DataFilters|PushedFilters): \[[^\]]*\]", plan))
        assert "date" not in filters
    types = {r[0] for r in tv.bsak(spark, SF_SMALL, "part").select("Document_Type").distinct().collect()}
    assert "ZP" in types
    labels = {r["type"] for r in E.queries()["invoice_payment_mix"](spark, SF_SMALL).select("type").distinct().collect()}
    assert len(labels) == 4


def test_vendor_master_of_a_row_per_part_and_year_is_not_broadcast(spark, tmp_dir):
    """Spark estimates the exploded master by the parts alone; the joins by vendor merge, whatever the parts' size."""
    from ledgerlens import schemas as S
    from ledgerlens.sources import testviews as tv

    rows = [(i, f"part {i}") for i in range(50)] + [(None, "no key"), (7, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_dir}/part.parquet")
    master = tv.lfa1(spark, tmp_dir)
    years = range(tv.FIRST_YEAR, tv.LAST_YEAR + 1)
    wanted = [("-".join(str(x) for x in (k, y) if x is not None), name) for k, name in rows for y in years]
    assert sorted(map(str, map(tuple, master.collect()))) == sorted(map(str, wanted))
    for name in ("invoice_file", "eligible_invoices", "sundry_invoices"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and f"__rk0_{S.VENDOR}" in line]
        assert joins and all("SortMergeJoin" in j for j in joins), (name, joins)
