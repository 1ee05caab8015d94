"""The registered queries: each audit operator run over the stand-in tables.

Every query reads the whole test tables of ``sf_dir`` (no sampling, no
row caps) and returns a DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions import arrays
from ledgerlens.operators import enrich, payables, receivables
from ledgerlens.session import materialize
from ledgerlens.sources import erp, ragged
from ledgerlens.sources import testviews as tv

Query = Callable[[SparkSession, str], DataFrame]


def _invoice_file(spark: SparkSession, d: str, variant: str, vendor_master: bool = True) -> DataFrame:
    return enrich.invoice_file(
        tv.bsak(spark, d, variant), tv.lfa1(spark, d, variant), tv.t001(spark, d), vendor_master=vendor_master
    )


def _eligible(spark: SparkSession, d: str, variant: str, vendor_master: bool = True) -> DataFrame:
    return payables.eligible_invoices(_invoice_file(spark, d, variant, vendor_master))


def _pairs(spark: SparkSession, d: str, variant: str) -> DataFrame:
    return payables.po_pairs(tv.ekbe_pairs(spark, d, variant))


def _sundry(spark: SparkSession, d: str, variant: str, vendor_master: bool = True) -> DataFrame:
    return payables.sundry_invoices(_eligible(spark, d, variant, vendor_master), _pairs(spark, d, variant))


# Queries below that report no vendor-master column pass vendor_master=False.


def q_invoice_file(spark, d):
    return _invoice_file(spark, d, "part")


def q_po_file(spark, d):
    return enrich.po_file(tv.rseg(spark, d), tv.ekpo(spark, d), tv.ekbe(spark, d))


def q_po_reference_pairs(spark, d):
    return payables.po_pairs(tv.ekbe_with_vendors(spark, d), tv.rseg(spark, d), tv.ekpo(spark, d))


def q_repair_ragged_po_lines(spark, d):
    return ragged.repair_ragged_lines(ragged.po_lines_from_lineitem(spark, d), ragged.PO_LINE_COLUMNS)


def q_eligible_invoices(spark, d):
    return _eligible(spark, d, "part")


def q_po_paid_invoices(spark, d):
    return payables.po_paid_invoices(_eligible(spark, d, "part"), _pairs(spark, d, "part"))


def q_sundry_invoices(spark, d):
    return _sundry(spark, d, "part")


def q_vendors_paid_both_ways(spark, d):
    return payables.vendors_paid_both_ways(_eligible(spark, d, "part", False), _pairs(spark, d, "part"))


def q_invoice_payment_mix(spark, d):
    return payables.invoice_payment_mix(_eligible(spark, d, "part"), _pairs(spark, d, "part"))


def q_invoice_frequency(spark, d):
    return payables.invoice_frequency(_eligible(spark, d, "part", False))


def q_sundry_document_totals(spark, d):
    return payables.sundry_document_totals(_sundry(spark, d, "supp", False))


def q_recurring_sundry(spark, d):
    return payables.recurring_sundry(_sundry(spark, d, "supp", False))


def q_consecutive_run_lengths(spark, d):
    return payables.consecutive_run_lengths(_sundry(spark, d, "supp", False))


def q_recurrence_profile(spark, d):
    return payables.recurrence_profile(_sundry(spark, d, "supp", False))


def q_recurrence_lists(spark, d):
    lists = payables.recurrence_lists(_sundry(spark, d, "supp", False))
    texts = [arrays.list_text(c).alias(c) for c in ("month_lists", "week_lists", "week_times")]
    return lists.select(*[c for c in lists.columns if not c.endswith(("_lists", "_times"))], *texts)


def q_list_run_lengths(spark, d):
    """Runs of consecutive months and weeks of each list (or part of one), counted on the arrays."""
    lists = payables.recurrence_lists(_sundry(spark, d, "supp", False))
    runs = {c: arrays.list_text(arrays.count_consec(f"{c}_lists")) for c in ("month", "week")}
    return lists.select(S.VENDOR, S.AMT_DOC, "part", *[c.alias(f"{k}_runs") for k, c in runs.items()])


def q_approximate_frequency(spark, d):
    """The estimates from daily sketches held against O9: the estimate itself has no SQL form, its bound has."""
    eligible = _eligible(spark, d, "part", False)
    sketches = materialize(payables.document_sketches(eligible), "document-sketches")
    both = payables.invoice_frequency(eligible).join(payables.approximate_frequency(sketches), S.VENDOR)
    exact, found = F.col("Invoice_Frequency"), F.col("Approximate_Frequency")
    near = F.abs(found - exact) <= F.greatest(F.lit(1.0), 0.08 * exact)
    return both.select(S.VENDOR, exact, near.alias("within_bound"))


def _bsak_csv(spark, d):
    return erp.read_csv_text(spark, tv.write_bsak_extract(spark, d))


def q_csv_invoice_lines(spark, d):
    """Invoice lines written as an extract in CSV files, with cells in many forms, and read by the typed reader."""
    fields, rename, _ = erp.EXTRACTS["bsak"]
    return erp.typed(_bsak_csv(spark, d), fields, rename)


def q_csv_rejects(spark, d):
    """What the typed reader could not take over as it is from the same extract."""
    return erp.rejects(_bsak_csv(spark, d), erp.EXTRACTS["bsak"][0], "bsak")


def q_rejected_ragged_po_lines(spark, d):
    lost = ragged.rejected_ragged_lines(ragged.po_lines_from_lineitem(spark, d))
    return lost.select(F.size(ragged.FIELDS).alias("n_fields"), F.array_join(ragged.FIELDS, "|").alias("cells"))


def q_one_time_vendor_invoices(spark, d):
    return payables.one_time_vendor_invoices(_eligible(spark, d, "cust", False))


def q_single_document_vendor_invoices(spark, d):
    return payables.single_document_vendor_invoices(_eligible(spark, d, "cust", False))


def q_ar_listing(spark, d):
    return enrich.ar_listing(tv.bsid(spark, d), tv.knkk(spark, d), tv.t001(spark, d))


def q_document_balances(spark, d):
    return receivables.document_balances(tv.bsid(spark, d), tv.knkk(spark, d), as_of=tv.AS_OF)


def q_ar_aging_by_customer(spark, d):
    return receivables.ar_aging_by_customer(
        tv.bsid(spark, d), tv.knkk(spark, d), tv.t001(spark, d), as_of=tv.AS_OF
    )


def q_credit_limit_status(spark, d):
    return receivables.credit_limit_status(tv.bsid(spark, d), tv.knkk(spark, d), as_of=tv.AS_OF)


QUERIES: dict[str, Query] = {
    "invoice_file": q_invoice_file,
    "repair_ragged_po_lines": q_repair_ragged_po_lines,
    "po_file": q_po_file,
    "po_reference_pairs": q_po_reference_pairs,
    "eligible_invoices": q_eligible_invoices,
    "po_paid_invoices": q_po_paid_invoices,
    "sundry_invoices": q_sundry_invoices,
    "vendors_paid_both_ways": q_vendors_paid_both_ways,
    "invoice_payment_mix": q_invoice_payment_mix,
    "invoice_frequency": q_invoice_frequency,
    "sundry_document_totals": q_sundry_document_totals,
    "recurring_sundry": q_recurring_sundry,
    "recurrence_profile": q_recurrence_profile,
    "consecutive_run_lengths": q_consecutive_run_lengths,
    "recurrence_lists": q_recurrence_lists,
    "list_run_lengths": q_list_run_lengths,
    "approximate_frequency": q_approximate_frequency,
    "csv_invoice_lines": q_csv_invoice_lines,
    "csv_rejects": q_csv_rejects,
    "rejected_ragged_po_lines": q_rejected_ragged_po_lines,
    "one_time_vendor_invoices": q_one_time_vendor_invoices,
    "single_document_vendor_invoices": q_single_document_vendor_invoices,
    "ar_listing": q_ar_listing,
    "document_balances": q_document_balances,
    "ar_aging_by_customer": q_ar_aging_by_customer,
    "credit_limit_status": q_credit_limit_status,
}
