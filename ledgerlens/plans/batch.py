"""End-to-end audit runs: the AP batch (Tasks 1-4), the AR aging (Task 5)
and the dashboard extracts.

The AP tasks share one prefix: eligible invoice lines with their PO-paid
flag.  It is written once under the checkpoint folder (lineage cut, survives
executor loss) and every report reads it, instead of each report re-reading
and re-joining the extracts.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import enrich, payables, receivables
from ledgerlens.plans.sinks import write_report
from ledgerlens.session import materialize, release
from ledgerlens.sources import erp, ragged


@dataclass
class PayablesInputs:
    bsak: DataFrame
    lfa1: DataFrame
    t001: DataFrame
    ekbe: DataFrame
    rseg: DataFrame | None = None
    ekpo: DataFrame | None = None


@dataclass
class ReceivablesInputs:
    bsid: DataFrame
    knkk: DataFrame
    t001: DataFrame


def flagged_invoices(inp: PayablesInputs) -> DataFrame:
    """Eligible invoice lines with ``is_po_paid``, written once."""
    eligible = payables.eligible_invoices(enrich.invoice_file(inp.bsak, inp.lfa1, inp.t001))
    pairs = payables.po_pairs(inp.ekbe, inp.rseg, inp.ekpo)
    return payables.flagged_once(eligible, pairs)


def payables_reports(inp: PayablesInputs) -> dict[str, DataFrame]:
    """Task 1-4 reports (and the dashboard extracts) from one shared prefix."""
    flagged = flagged_invoices(inp)
    cols = [c for c in flagged.columns if c != payables.IS_PO]
    eligible = flagged.select(cols)
    sundry = flagged.where(~F.col(payables.IS_PO)).select(cols)
    shared = payables.recurrence_runs(sundry)
    return {
        "task1": payables.vendors_paid_both_ways_flagged(flagged),
        "task2": payables.invoice_frequency(eligible),
        "task3": payables.recurring_sundry(sundry),
        "task4": payables.one_time_vendor_invoices(eligible),
        "invoice_file_type": payables.invoice_payment_mix_flagged(flagged),
        "recur_invoice": payables.recurrence_profile(sundry, shared=shared),
        "recur_weeks": payables.consecutive_run_lengths(sundry, shared=shared),
        "one_time_vendors_invoices": payables.single_document_vendor_invoices(eligible),
    }


def receivables_reports(inp: ReceivablesInputs, as_of: _dt.date | str, fan_out: bool = True) -> dict[str, DataFrame]:
    return {
        "task5": receivables.ar_aging_by_customer(inp.bsid, inp.knkk, inp.t001, as_of=as_of, fan_out=fan_out),
        "balance_amount": receivables.credit_limit_status(inp.bsid, inp.knkk, as_of=as_of, fan_out=fan_out),
    }


def run_reports(reports: dict[str, DataFrame], out_dir: str, fmt: str = "csv") -> dict[str, str]:
    """Write every report under ``out_dir``; returns name -> path."""
    return {name: write_report(df, f"{out_dir.rstrip('/')}/{name}", fmt) for name, df in reports.items()}


# File names of the ERP extracts in an extract folder.
EXTRACT_FILES = {
    "bsak": "BSAK_BKPF_AltColTitles.csv",
    "t001": "T001_AltColTitles.csv",
    "lfa1": "LFA1_AltColTitles.csv",
    "ekpo": "EKPO_EKKO_AltColTitles.csv",
    "rseg": "RSEG_RBKP_AltColTitles.csv",
    "ekbe": "EKBE_AltColTitles.csv",
    "bsid": "BSID_BKPF_AltColTitles.csv",
    "knkk": "KNKK_AltColTitles.csv",
}


# Inputs that may be left out on purpose: without them the (null, null) PO pair does not arise.
OPTIONAL = ("rseg", "ekpo")


def run_from_extracts(
    spark,
    folder: str,
    out_dir: str,
    as_of,
    fmt: str = "csv",
    fan_out: bool = True,
    without: tuple[str, ...] = (),
    fail_on_rejects: bool = False,
) -> dict[str, str]:
    """Read the ERP extracts of ``folder`` and write Tasks 1-5, the dashboard
    extracts and a report of rejects under ``out_dir``.

    Every extract must be there and have its columns; ``without`` names
    optional ones (``rseg``, ``ekpo``) that are left out on purpose.
    Quoted cells may hold line breaks.  The
    rejects report lists cells that could not be read, records that do not
    fit the header and PO lines that the rules cannot repair;
    ``fail_on_rejects`` stops instead where there are any.
    """
    unknown = set(without) - set(OPTIONAL)
    if unknown:
        raise ValueError(f"only {OPTIONAL} may be left out, not {sorted(unknown)}")

    def path(key):
        return f"{folder.rstrip('/')}/{EXTRACT_FILES[key]}"

    tables, rejected = {}, []
    for key, (fields, rename, encoding) in erp.EXTRACTS.items():
        if key not in without:
            raw = erp.read_csv_text(spark, path(key), encoding)
            tables[key] = erp.typed(raw, fields, rename)
            rejected.append(erp.rejects(raw, fields, EXTRACT_FILES[key]))
    if "ekpo" not in without:
        tables["ekpo"] = ragged.read_ragged_csv(spark, path("ekpo"))
        lost = ragged.rejected_ragged_lines(ragged.read_lines(spark, path("ekpo")))
        rejected.append(
            lost.select(
                F.lit(EXTRACT_FILES["ekpo"]).alias("file"),
                F.lit("po_line").alias("kind"),
                F.lit(None).cast("string").alias("column"),
                F.array_join(ragged.FIELDS, ",").alias("value"),
            )
        )
    rejects = materialize(reduce(DataFrame.unionByName, rejected), "rejects")
    if fail_on_rejects and not rejects.isEmpty():
        raise ValueError(f"extracts with rejects, the first: {rejects.first()}")
    pin = PayablesInputs(**{k: tables.get(k) for k in ("bsak", "lfa1", "t001", "ekbe", "rseg", "ekpo")})
    rin = ReceivablesInputs(bsid=tables["bsid"], knkk=tables["knkk"], t001=tables["t001"])
    reports = {**payables_reports(pin), **receivables_reports(rin, as_of, fan_out), "rejects": rejects}
    written = run_reports(reports, out_dir, fmt)
    release(spark)
    return written
