"""Accounts-payable analytics.

All of them start from the eligible invoice lines and one fact per line:
is the line's (vendor, reference) pair in the PO history?  ("PO-paid";
otherwise the line is a *sundry* expense.)  Everything else is per-vendor or
per-document aggregation of that flag, joined back where rows are needed.

Scale notes
-----------
* The PO pairs are the *distinct* (vendor, reference) pairs of the PO
  history (partial aggregation before the shuffle), so flagging never
  multiplies invoice rows.
* Per-vendor facts come from ``groupBy`` (map-side partial aggregation: a
  vendor with a third of all rows still sends one row per map task); they go
  back to rows by an equi-join whose hot partitions AQE splits.
* Distinct counts per vendor that only need "exactly one" use
  ``min == max`` instead of ``countDistinct``: one partial aggregation, no
  expand / double shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.dates import week_of_year_monday
from ledgerlens.functions.joins import nullsafe_join
from ledgerlens.functions.money import sum0
from ledgerlens.functions.nullsafe import not_in_keep_null
from ledgerlens.operators.runs import POSITION, RUN_INDEX, consecutive_runs, run_lengths
from ledgerlens.session import materialize

IS_PO = "is_po_paid"
HAS_PO = "has_po_paid"
HAS_SUNDRY = "has_sundry"


# ---------------------------------------------------------------- O4 / PO pairs


def eligible_invoices(invoice_file: DataFrame, excluded=S.PAYMENT_DOC_TYPES) -> DataFrame:
    """Drop payment documents; lines without a document type are kept."""
    return invoice_file.where(not_in_keep_null(S.DOC_TYPE, excluded))


def po_pairs(
    ekbe: DataFrame,
    rseg: DataFrame | None = None,
    ekpo: DataFrame | None = None,
) -> DataFrame:
    """Distinct (vendor, reference) pairs of the PO file.

    The PO file is a full outer join that keeps every history row, so its
    pairs are the history's pairs -- plus (null, null) when some receipt or
    PO line has no history row (its history columns are then null, and a
    null pair matches invoices with neither vendor nor reference).  Pass
    ``rseg`` / ``ekpo`` to add that pair exactly as the joined file would.
    """
    pairs = ekbe.select(S.PO_VENDOR, S.REF).distinct()
    others = [d.select(S.PO_NUM, S.PO_ITEM) for d in (rseg, ekpo) if d is not None]
    if others:
        lines = others[0]
        for o in others[1:]:
            lines = lines.unionByName(o)
        orphans = nullsafe_join(lines, ekbe.select(S.PO_NUM, S.PO_ITEM), [S.PO_NUM, S.PO_ITEM], "left_anti")
        null_pair = orphans.select(
            F.lit(None).cast("string").alias(S.PO_VENDOR), F.lit(None).cast("string").alias(S.REF)
        ).distinct()
        pairs = pairs.unionByName(null_pair).distinct()
    return pairs


def _match_po(eligible: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    return nullsafe_join(eligible, pairs, [S.VENDOR, S.REF], how, right_keys=[S.PO_VENDOR, S.REF])


def flag_po_paid(eligible: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``is_po_paid``: the line's (vendor, reference) is in the PO pairs."""
    marked = pairs.withColumn("__po", F.lit(True))
    return (
        _match_po(eligible, marked, "left")
        .withColumn(IS_PO, F.coalesce(F.col("__po"), F.lit(False)))
        .drop("__po")
    )


def flagged_once(eligible: DataFrame, pairs: DataFrame) -> DataFrame:
    """``flag_po_paid``, written once: the lines and the per-vendor facts both
    read it, so invoice lines and PO history are scanned and joined once."""
    return materialize(flag_po_paid(eligible, pairs), "flagged-invoices")


def vendor_flags(flagged: DataFrame) -> DataFrame:
    """One row per vendor (the null vendor is a vendor too): has PO / sundry lines."""
    return flagged.groupBy(S.VENDOR).agg(
        F.max(F.col(IS_PO)).alias(HAS_PO),
        F.max(~F.col(IS_PO)).alias(HAS_SUNDRY),
    )


# ---------------------------------------------------------------- O5 - O8


def po_paid_invoices(eligible: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct eligible lines whose (vendor, reference) is in the PO history."""
    return _match_po(eligible, pairs, "left_semi").distinct()


def sundry_invoices(eligible: DataFrame, pairs: DataFrame) -> DataFrame:
    """Eligible lines that are not PO-paid; duplicate lines are kept.

    Matching a whole line against the PO-paid lines reduces to matching its
    (vendor, reference), because PO-paid-ness depends on nothing else.
    """
    return _match_po(eligible, pairs, "left_anti")


def vendors_paid_both_ways(eligible: DataFrame, pairs: DataFrame) -> DataFrame:
    """O7 (Task 1): every eligible line of vendors with both PO-paid and sundry lines."""
    return vendors_paid_both_ways_flagged(flagged_once(eligible, pairs))


def vendors_paid_both_ways_flagged(flagged: DataFrame) -> DataFrame:
    """O7 on lines already carrying ``is_po_paid``."""
    both = vendor_flags(flagged).where(F.col(HAS_PO) & F.col(HAS_SUNDRY)).select(S.VENDOR)
    return nullsafe_join(flagged, both, [S.VENDOR], "left_semi").select(S.TASK1_COLUMNS)


def invoice_payment_mix(eligible: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every eligible line labelled both_sundry / only_sundry / both_po / only_po.

    PO-paid lines are deduplicated (they come from an inner merge followed by
    drop-duplicates in the original); sundry lines are not.
    """
    return invoice_payment_mix_flagged(flagged_once(eligible, pairs))


def invoice_payment_mix_flagged(flagged: DataFrame) -> DataFrame:
    """O8 on lines already carrying ``is_po_paid``.

    The per-vendor flags are aggregated once and joined onto each part; the
    PO part is deduplicated before that join, and sundry lines flow through
    without any shuffle of their own besides the flag join.
    """
    cols = [c for c in flagged.columns if c != IS_PO]
    flags = vendor_flags(flagged)
    sundry = nullsafe_join(flagged.where(~F.col(IS_PO)).select(cols), flags, [S.VENDOR], "left").select(
        *cols, F.when(F.col(HAS_PO), F.lit(S.BOTH_SUNDRY)).otherwise(F.lit(S.ONLY_SUNDRY)).alias("type")
    )
    po = nullsafe_join(flagged.where(F.col(IS_PO)).select(cols).distinct(), flags, [S.VENDOR], "left").select(
        *cols, F.when(F.col(HAS_SUNDRY), F.lit(S.BOTH_PO)).otherwise(F.lit(S.ONLY_PO)).alias("type")
    )
    return sundry.unionByName(po)


# ---------------------------------------------------------------- O9 - O13


def invoice_frequency(eligible: DataFrame) -> DataFrame:
    """O9 (Task 2): number of distinct documents per vendor."""
    return (
        eligible.where(F.col(S.VENDOR).isNotNull())
        .groupBy(S.VENDOR)
        .agg(F.countDistinct(S.DOC).alias("Invoice_Frequency"))
    )


def sundry_document_totals(sundry: DataFrame) -> DataFrame:
    """Both amounts summed per (vendor, document, document date)."""
    keys = [S.VENDOR, S.DOC, S.DOC_DATE]
    return (
        sundry.where(F.col(S.VENDOR).isNotNull() & F.col(S.DOC).isNotNull() & F.col(S.DOC_DATE).isNotNull())
        .groupBy(*keys)
        .agg(sum0(S.AMT_LOC).alias(S.AMT_LOC), sum0(S.AMT_DOC).alias(S.AMT_DOC))
    )


def recurring_totals(totals: DataFrame) -> DataFrame:
    """Document totals whose (vendor, document amount) occurs more than once.

    A count per (vendor, amount) plus a semi-join instead of a window: the
    count is partially aggregated, and the join's hot partitions can be split.
    """
    keys = [S.VENDOR, S.AMT_DOC]
    repeated = totals.groupBy(*keys).count().where(F.col("count") > 1).select(*keys)
    return totals.join(repeated, keys, "left_semi")


def recurring_sundry(sundry: DataFrame) -> DataFrame:
    """O11 (Task 3): recurring sundry document totals with document attributes.

    Attributes are matched on (vendor, document) without the date, as in the
    original.  The sundry lines are aggregated once to (document, date,
    attributes) -- a table far smaller than the lines -- and written under the
    checkpoint folder; document totals, the recurring test and the distinct
    attributes are all read from it, so the lines are read and shuffled once
    instead of once per branch.  The distinct attributes make the joined rows
    distinct already.
    """
    attr_cols = [S.COMPANY, S.COMPANY_NAME, S.DOC_TYPE, S.REF, S.DOC_CUR, S.LOC_CUR]
    parts = materialize(
        sundry.groupBy(S.VENDOR, S.DOC, S.DOC_DATE, *attr_cols).agg(
            F.sum(S.AMT_LOC).alias("_loc"), F.sum(S.AMT_DOC).alias("_doc")
        ),
        "sundry-parts",
    )
    totals = (
        parts.where(F.col(S.VENDOR).isNotNull() & F.col(S.DOC).isNotNull() & F.col(S.DOC_DATE).isNotNull())
        .groupBy(S.VENDOR, S.DOC, S.DOC_DATE)
        .agg(sum0("_loc").alias(S.AMT_LOC), sum0("_doc").alias(S.AMT_DOC))
    )
    attrs = parts.select(S.VENDOR, S.DOC, *attr_cols).distinct()
    return nullsafe_join(recurring_totals(totals), attrs, [S.VENDOR, S.DOC], "left").select(S.TASK3_COLUMNS)


def _recurring_documents(sundry: DataFrame) -> DataFrame:
    """Recurring document totals, from document totals written once (the
    recurring test reads them twice: a count and a semi-join)."""
    return recurring_totals(materialize(sundry_document_totals(sundry), "sundry-totals"))


def document_order(doc: str = S.DOC, doc_date: str = S.DOC_DATE) -> list[Column]:
    """(document, date) order of the grouped document totals.

    Document numbers read from the extracts are numbers, so they sort
    numerically; non-numeric ones sort first, then as text.
    """
    return [
        F.col(doc).try_cast("bigint").asc_nulls_first(),
        F.col(doc).asc_nulls_first(),
        F.col(doc_date).asc_nulls_first(),
    ]


def _week_sequence(recur: DataFrame, absolute: bool) -> DataFrame:
    d = F.col(S.DOC_DATE)
    if absolute:
        # Months and weeks that do not wrap at New Year (1970-01-05 is a Monday).
        month = (F.year(d) * 12 + F.month(d) - 1).cast("int")
        week = F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7).cast("int")
    else:
        month = F.month(d).cast("int")
        week = week_of_year_monday(d)
    return recur.withColumn("date", d).withColumn("month", month).withColumn("week", week)


def _runs(seq: DataFrame, order: str) -> DataFrame:
    keys = [S.VENDOR, S.AMT_DOC]
    if order == "document":
        return consecutive_runs(seq, keys, document_order(), "week")
    if order == "week":
        # Distinct weeks in ascending order (the reading of the worked example).
        weeks = seq.select(*keys, "week").distinct()
        return consecutive_runs(weeks, keys, [F.col("week").asc_nulls_first()], "week")
    raise ValueError(f"order must be 'document' or 'week', not {order!r}")


def recurrence_runs(
    sundry: DataFrame, order: str = "document", absolute: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The recurring documents with their months and weeks, and the same with their runs, written once.

    Both O12 and O13 can be built on them, see their ``shared`` parameter.
    """
    seq = _week_sequence(_recurring_documents(sundry), absolute)
    return seq, materialize(_runs(seq, order), "recurrence-runs")


def consecutive_run_lengths(
    sundry: DataFrame, order: str = "document", absolute: bool = False, shared: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Runs of consecutive weeks per recurring (vendor, amount).

    One row per run: ``run_index`` (1-based, in sequence order),
    ``run_length`` and the run's ``first_week``.  ``order='document'`` scans
    weeks in document order with repeats (as the original lists are built);
    ``order='week'`` scans the distinct weeks ascending.
    """
    _, runs = shared or recurrence_runs(sundry, order, absolute)
    return run_lengths(runs, [S.VENDOR, S.AMT_DOC], "week")


def recurrence_profile(
    sundry: DataFrame, order: str = "document", absolute: bool = False, shared: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Each recurring sundry document with its (vendor, amount) pattern.

    Per document: date, month, %W week and its ``position`` in the group's
    sequence.  Per group: ``times`` (documents), ``month_count`` (distinct
    months), ``run_count`` (runs of consecutive weeks) and
    ``max_consecutive_weeks``.  The original also attached the month / week /
    run lists of the group to every row; a list per row is quadratic in the
    group size, so ``recurrence_lists`` gives them once per group.
    """
    keys = [S.VENDOR, S.AMT_DOC]
    seq, runs = shared or recurrence_runs(sundry, order, absolute)
    per_run = run_lengths(runs, keys, "week")
    per_group = per_run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("run_count"),
        F.max("run_length").cast("int").alias("max_consecutive_weeks"),
    )
    # Documents and distinct months per group, from the document rows (the
    # materialised scan when it holds them).
    doc_rows = runs if order == "document" else seq
    months = doc_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("times"), F.countDistinct("month").alias("month_count")
    )
    stats = per_group.join(months, keys)
    if order == "document":
        rows = runs.select(
            S.VENDOR, S.DOC, S.DOC_DATE, S.AMT_LOC, S.AMT_DOC, "date", "month", "week",
            F.col(POSITION).cast("int").alias(POSITION),
        )
    else:
        # Position of a document = position of its week in the distinct-week sequence.
        wpos = runs.select(*keys, "week", F.col(POSITION).cast("int").alias(POSITION))
        rows = seq.join(wpos, [*keys, "week"], "left").select(
            S.VENDOR, S.DOC, S.DOC_DATE, S.AMT_LOC, S.AMT_DOC, "date", "month", "week", POSITION
        )
    return rows.join(stats, keys).select(
        S.VENDOR, S.DOC, S.DOC_DATE, S.AMT_LOC, S.AMT_DOC, "date", "month", "week", POSITION,
        F.col("times").cast("bigint").alias("times"),
        F.col("month_count").cast("bigint").alias("month_count"),
        F.col("run_count").cast("bigint").alias("run_count"),
        "max_consecutive_weeks",
    )


#: Elements of a list in ``recurrence_lists``; longer groups come in several parts.
LIST_ITEMS = 10_000


def recurrence_lists(
    sundry: DataFrame, absolute: bool = False, max_items: int = LIST_ITEMS, shared: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """O12's lists: one row per recurring (vendor, amount) with its months, weeks and run lengths in document order.

    ``month_lists`` and ``week_lists`` hold one element per document,
    ``week_times`` one per run of consecutive weeks.  A group of more than
    ``max_items`` documents comes in several rows, numbered by ``part`` from 0
    on (``parts`` of them) and cut by position, so that no row and no task holds
    more; a run is in the part in which it begins, and the parts' lists
    in a row are the whole lists.  The positions come from the range-partitioned
    scan of O13, so a group is never sorted or gathered as a whole.
    """
    keys = [S.VENDOR, S.AMT_DOC]
    _, runs = shared or recurrence_runs(sundry, "document", absolute)
    part = F.floor((F.col(POSITION) - 1) / max_items).cast("int").alias("part")
    documents = runs.groupBy(*keys, part).agg(
        F.array_sort(F.collect_list(F.struct(POSITION, "month", "week"))).alias("_rows")
    )
    lengths = runs.groupBy(*keys, RUN_INDEX).agg(F.count(F.lit(1)).cast("int").alias("n"), F.min(POSITION).alias(POSITION))
    times = lengths.groupBy(*keys, part).agg(F.array_sort(F.collect_list(F.struct(POSITION, "n"))).alias("_runs"))
    per_group = lengths.groupBy(*keys).agg(F.count(F.lit(1)).alias("run_count"), F.max("n").alias("max_consecutive_weeks"))
    months = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), F.countDistinct("month").alias("month_count"))
    none = F.array().cast("array<int>")
    return (
        documents.join(times, [*keys, "part"], "left")
        .join(months.join(per_group, keys), keys)
        .select(
            *keys,
            "part",
            F.ceil(F.col("times") / max_items).cast("int").alias("parts"),
            "times",
            "month_count",
            "run_count",
            "max_consecutive_weeks",
            F.transform("_rows", lambda r: r["month"]).alias("month_lists"),
            F.transform("_rows", lambda r: r["week"]).alias("week_lists"),
            F.coalesce(F.transform("_runs", lambda r: r["n"]), none).alias("week_times"),
        )
    )


# ---------------------------------------------------------------- O9, approximate and by date

#: log2 of the registers of a sketch: a relative standard error of about 1.6 %, at most 4 KB each.
SKETCH_LOG_K = 12


def document_sketches(eligible: DataFrame, log_k: int = SKETCH_LOG_K) -> DataFrame:
    """Mergeable sketches of the distinct documents, one row per vendor and document date (opt-in to O9).

    Store them once (a day's rows never change) and merge any range of days
    with ``approximate_frequency``; new days are appended.  Few documents are
    held as they are, so most sketches are some bytes.
    """
    known = eligible.where(F.col(S.VENDOR).isNotNull() & F.col(S.DOC).isNotNull())
    return known.groupBy(S.VENDOR, F.col(S.DOC_DATE).alias("day")).agg(F.hll_sketch_agg(S.DOC, log_k).alias("sketch"))


def approximate_frequency(sketches: DataFrame, first=None, last=None) -> DataFrame:
    """Estimated distinct documents per vendor over the days from ``first`` to ``last`` (both optional and inclusive).

    Without a range it estimates what ``invoice_frequency`` counts, undated documents included; vendors
    without any document are missing.
    """
    if first is not None:
        sketches = sketches.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        sketches = sketches.where(F.col("day") <= F.lit(last).cast("date"))
    return sketches.groupBy(S.VENDOR).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("Approximate_Frequency"))


# ---------------------------------------------------------------- O14 / O15


def _exactly_one(col: str) -> Column:
    """countDistinct(col) == 1, as a plain partial aggregate."""
    return (F.count(col) > 0) & (F.min(col) == F.max(col))


def one_time_vendor_invoices(eligible: DataFrame) -> DataFrame:
    """O14 (Task 4): distinct lines of vendors with one document and one line number."""
    one_time = (
        eligible.where(F.col(S.VENDOR).isNotNull())
        .groupBy(S.VENDOR)
        .agg((_exactly_one(S.DOC) & _exactly_one(S.LINE)).alias("_one"))
        .where("_one")
        .select(S.VENDOR)
    )
    return eligible.join(one_time, S.VENDOR, "left_semi").select(S.TASK4_COLUMNS).distinct()


def single_document_vendor_invoices(eligible: DataFrame) -> DataFrame:
    """Distinct lines (without company name) of vendors with one document."""
    single = (
        eligible.where(F.col(S.VENDOR).isNotNull())
        .groupBy(S.VENDOR)
        .agg(_exactly_one(S.DOC).alias("_one"))
        .where("_one")
        .select(S.VENDOR)
    )
    return eligible.join(single, S.VENDOR, "left_semi").select(S.SINGLE_DOC_COLUMNS).distinct()


__all__ = [
    "IS_PO",
    "LIST_ITEMS",
    "RUN_INDEX",
    "approximate_frequency",
    "consecutive_run_lengths",
    "document_order",
    "document_sketches",
    "eligible_invoices",
    "flag_po_paid",
    "flagged_once",
    "invoice_frequency",
    "invoice_payment_mix",
    "invoice_payment_mix_flagged",
    "one_time_vendor_invoices",
    "po_pairs",
    "po_paid_invoices",
    "recurrence_lists",
    "recurrence_profile",
    "recurrence_runs",
    "recurring_sundry",
    "recurring_totals",
    "single_document_vendor_invoices",
    "sundry_document_totals",
    "sundry_invoices",
    "vendor_flags",
    "vendors_paid_both_ways",
    "vendors_paid_both_ways_flagged",
]
