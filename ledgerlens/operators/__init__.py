"""The audit operators, each a function from DataFrames to a DataFrame."""

from ledgerlens.operators.enrich import ar_listing, invoice_file, po_file
from ledgerlens.operators.payables import (
    consecutive_run_lengths,
    eligible_invoices,
    flag_po_paid,
    invoice_frequency,
    invoice_payment_mix,
    one_time_vendor_invoices,
    po_pairs,
    po_paid_invoices,
    recurrence_profile,
    recurring_sundry,
    single_document_vendor_invoices,
    sundry_document_totals,
    sundry_invoices,
    vendors_paid_both_ways,
)
from ledgerlens.operators.receivables import ar_aging_by_customer, credit_limit_status, document_balances
from ledgerlens.operators.runs import consecutive_runs, run_lengths

__all__ = [
    "ar_aging_by_customer",
    "ar_listing",
    "consecutive_run_lengths",
    "consecutive_runs",
    "credit_limit_status",
    "document_balances",
    "eligible_invoices",
    "flag_po_paid",
    "invoice_file",
    "invoice_frequency",
    "invoice_payment_mix",
    "one_time_vendor_invoices",
    "po_file",
    "po_pairs",
    "po_paid_invoices",
    "recurrence_profile",
    "recurring_sundry",
    "run_lengths",
    "single_document_vendor_invoices",
    "sundry_document_totals",
    "sundry_invoices",
    "vendors_paid_both_ways",
]
