"""Lookups that build the analysed tables (O1 invoice file, O3 PO file, O16 AR listing).

Every lookup is a left join on null-safe keys (a missing key matches a
missing key, as in the original merges).  No broadcast hints: Spark
broadcasts a lookup only when its size estimate is under the broadcast
threshold (AQE re-checks measured sizes); a large vendor master is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens import schemas as S
from ledgerlens.functions.joins import full_outer_nullsafe, nullsafe_join


def _suffix_clashes(right: DataFrame, left_cols: list[str], keys: list[str], suffix: str) -> DataFrame:
    """Rename non-key columns of ``right`` that also exist on the left."""
    clash = {c: c + suffix for c in right.columns if c in left_cols and c not in keys}
    return right.withColumnsRenamed(clash) if clash else right


def lookup_left(left: DataFrame, lookup: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left join of a lookup table on null-safe keys (join strategy left to Spark)."""
    lookup = _suffix_clashes(lookup, left.columns, keys, suffix)
    return nullsafe_join(left, lookup, keys, "left")


def invoice_file(bsak: DataFrame, lfa1: DataFrame, t001: DataFrame, *, vendor_master: bool = True) -> DataFrame:
    """O1: vendor invoice lines with vendor master and company attributes.

    ``bsak`` carries ``Document_Currency_Key`` and ``t001`` carries
    ``Local_Currency_Key`` (the sources rename both currency columns), so the
    two currencies never collide.

    With ``vendor_master=False`` (for analytics that report no vendor-master
    column) only the master's key is joined: a master with repeated keys fans
    lines out just the same, and the columns never depend on the data.
    """
    master = lfa1 if vendor_master else lfa1.select(S.VENDOR)
    return lookup_left(lookup_left(bsak, master, [S.VENDOR], "_vendor_master"), t001, [S.COMPANY], "_company")


def po_file(rseg: DataFrame, ekpo: DataFrame, ekbe: DataFrame) -> DataFrame:
    """O3: PO lines with invoice receipts and PO history, full outer on (PO, item).

    A PO item with m receipts and n history rows gives m x n rows, as the
    original merge does; the joins are of kinds whose hot keys AQE splits.
    Missing keys match missing keys.  The analytics never build this table:
    they read its distinct (vendor, reference) pairs (see ``payables.po_pairs``).
    """
    keys = [S.PO_NUM, S.PO_ITEM]
    return full_outer_nullsafe(full_outer_nullsafe(rseg, ekpo, keys), ekbe, keys)


def ar_listing(bsid: DataFrame, knkk: DataFrame, t001: DataFrame) -> DataFrame:
    """Open customer items with credit limit / area and company attributes.

    A customer with k credit areas gets each item k times (kept on purpose:
    the aging report's default sums over this fan-out).
    """
    knkk = _suffix_clashes(knkk, bsid.columns, [S.CUST], "_credit")
    out = nullsafe_join(bsid, knkk, [S.CUST], "left")
    return lookup_left(out, t001, [S.COMPANY], "_company")
