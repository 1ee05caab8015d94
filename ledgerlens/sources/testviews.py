"""Stand-in ERP tables over the star-schema test tables (FIXTURES.md part B).

Only the mapping lives here; the analytics receive the same columns they
receive from the ERP readers in ``ledgerlens.sources.erp``.  Scans are lazy
parquet reads, so Catalyst pushes the filters and prunes the columns below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.money import money
from ledgerlens.session import intermediate_path

AS_OF = "1998-07-01"

TABLES = (
    "region nation customer supplier part orders lineitem "
    "events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _str(c: str) -> Column:
    return F.col(c).cast("string")


def t001(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company codes: one per nation; local currency from the region."""
    return table(spark, sf_dir, "nation").select(
        _str("n_nationkey").alias(S.COMPANY),
        F.col("n_name").alias(S.COMPANY_NAME),
        F.concat(F.lit("CUR"), _str("n_regionkey")).alias(S.LOC_CUR),
    )


# Vendor keys.  A vendor is a part in an order year, a supplier, or a customer in an order month; the
# year and month keep vendors small enough for all four payment labels and for one-time vendors to occur
# while every line is read.
FIRST_YEAR, LAST_YEAR = 1992, 2005


def _part_year() -> Column:
    return F.concat_ws("-", _str("l_partkey"), F.year("o_orderdate").cast("string"))


def _customer_month() -> Column:
    return F.concat_ws("-", _str("o_custkey"), F.date_format("o_orderdate", "yyyyMM"))


# Which lines are invoices and which PO history, and the vendor and reference of both sides.
_AP = {
    "part": dict(vendor=_part_year, ref="l_suppkey", where=lambda: F.col("l_linestatus") == "O"),
    "supp": dict(vendor=lambda: _str("l_suppkey"), ref="l_partkey", where=lambda: F.col("l_linestatus") == "O"),
    "cust": dict(vendor=_customer_month, ref="l_suppkey", where=lambda: F.lit(True)),
}


def bsak(spark: SparkSession, sf_dir: str, variant: str = "part") -> DataFrame:
    """Vendor invoice lines: one per open line item, booked in the supplier's nation."""
    v = _AP[variant]
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
        .where(v["where"]())
    )
    flag = F.col("l_returnflag")
    return rows.select(
        _str("s_nationkey").alias(S.COMPANY),
        v["vendor"]().alias(S.VENDOR),
        _str("l_orderkey").alias(S.DOC),
        F.col("l_linenumber").alias(S.LINE),
        F.when(flag == "R", F.lit("ZP")).otherwise(flag).alias(S.DOC_TYPE),
        F.col("o_orderdate").cast("date").alias(S.DOC_DATE),
        _str(v["ref"]).alias(S.REF),
        F.when(flag == "A", F.lit(S.DEBIT)).otherwise(F.lit(S.CREDIT)).alias(S.IND),
        money("l_extendedprice").alias(S.AMT_LOC),
        money("l_quantity").alias(S.AMT_DOC),
        F.concat(F.lit("CUR"), F.substring("o_orderpriority", 1, 1)).alias(S.DOC_CUR),
    )


def bsak_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bsak`` as the text cells of an extract: dates and amounts in several forms, some of them unreadable or
    with a decimal too many, and an item text whose cells hold commas, quotes and line breaks."""
    rows = bsak(spark, sf_dir)
    key, line = F.col(S.DOC).cast("long"), F.col(S.LINE)
    date, amount = F.col(S.DOC_DATE), F.col(S.AMT_LOC)
    forms = [F.date_format(date, p) for p in ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "d.M.yyyy", "d-MMM-yyyy")]
    dated = F.when(key % 101 == 0, "soon")
    for k, form in enumerate(forms[1:], 1):
        dated = dated.when(key % 5 == k, form)
    money_text = (
        F.when(key % 103 == 0, "n/a")
        .when(key % 107 == 0, F.concat(amount.cast("string"), F.lit("5")))
        .when(key % 3 == 1, F.format_number(amount, 2))
        .when(key % 3 == 2, F.concat(amount.cast("string"), F.lit("-")))
        .otherwise(amount.cast("string"))
    )
    text = F.when(line % 3 == 0, F.concat(F.lit('first, "quoted"\nsecond '), line.cast("string"))).otherwise(F.concat(F.lit("item "), line.cast("string")))
    cells = {S.DOC_DATE: dated.otherwise(forms[0]), S.AMT_LOC: money_text, S.DOC_CUR: F.col(S.DOC_CUR)}
    names = {S.DOC_CUR: S.CURRENCY}
    return rows.select(
        *[cells.get(c, F.col(c).cast("string")).alias(names.get(c, c)) for c in rows.columns], text.alias("Item_Text")
    )


def write_bsak_extract(spark: SparkSession, sf_dir: str) -> str:
    """A folder of CSV files with ``bsak_extract`` in the shared folder for intermediates."""
    path = intermediate_path(spark, "bsak-extract")
    bsak_extract(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return path


def lfa1(spark: SparkSession, sf_dir: str, variant: str = "part") -> DataFrame:
    """Vendor master matching ``bsak(variant)``."""
    if variant == "part":
        years = F.explode(F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR)))
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", years.alias("_year"))
        key = F.concat_ws("-", _str("p_partkey"), _str("_year"))
        # Spark's size estimate leaves out what explode adds, so without the hint the master, of as many rows as there
        # are parts times years, would be broadcast as long as the parts alone are small.
        return parts.select(key.alias(S.VENDOR), F.col("p_name").alias(S.VENDOR_NAME)).hint("merge")
    if variant == "supp":
        return table(spark, sf_dir, "supplier").select(_str("s_suppkey").alias(S.VENDOR), F.col("s_name").alias(S.VENDOR_NAME))
    months = table(spark, sf_dir, "orders").select("o_custkey", _customer_month().alias(S.VENDOR)).distinct()
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias(S.VENDOR_NAME))
    return months.join(names, "o_custkey").select(S.VENDOR, S.VENDOR_NAME)


def ekbe_pairs(spark: SparkSession, sf_dir: str, variant: str = "part") -> DataFrame:
    """PO history (vendor, reference) of finished line items."""
    v = _AP[variant]
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F")
    if variant != "supp":  # their vendor key needs the order
        orders = table(spark, sf_dir, "orders")
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return lines.select(v["vendor"]().alias(S.PO_VENDOR), _str(v["ref"]).alias(S.REF))


# The PO item of a line is (part, supplier).  Every line is in one of the three PO tables: returned and
# accepted lines are receipts while open and history when finished; the others are PO lines.


def _po_items(spark: SparkSession, sf_dir: str, where: Column, *more: Column) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(where)
    return lines.select(_str("l_partkey").alias(S.PO_NUM), _str("l_suppkey").alias(S.PO_ITEM), *more)


def rseg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice receipts per PO item (open lines that were accepted or returned)."""
    where = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "N")
    return _po_items(spark, sf_dir, where, _str("l_orderkey").alias("Invoice_Document_Number"))


def ekpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO lines: distinct PO items of the other lines."""
    return _po_items(spark, sf_dir, F.col("l_returnflag") == "N").distinct()


def ekbe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO history rows (finished lines that were accepted or returned)."""
    where = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "N")
    return _po_items(spark, sf_dir, where, _str("l_orderkey").alias("Material_Document_Number"))


def ekbe_with_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO history rows with the vendor (supplier) and reference (part) they were posted under."""
    return ekbe(spark, sf_dir).select(
        S.PO_NUM, S.PO_ITEM, F.col(S.PO_ITEM).alias(S.PO_VENDOR), F.col(S.PO_NUM).alias(S.REF)
    )


def bsid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open customer items: one per line item; returns are credits."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(orders, li.l_orderkey == orders.o_orderkey).join(supp, li.l_suppkey == supp.s_suppkey)
    return rows.select(
        _str("s_nationkey").alias(S.COMPANY),
        _str("o_custkey").alias(S.CUST),
        _str("o_orderkey").alias(S.REF),
        F.when(F.col("l_returnflag") == "R", F.lit(S.CREDIT)).otherwise(F.lit(S.DEBIT)).alias(S.IND),
        money("l_extendedprice").alias(S.AMT_LOC),
        F.col("l_shipdate").cast("date").alias(S.DOC_DATE),
        F.concat(F.lit("CUR"), F.substring("o_orderpriority", 1, 1)).alias(S.DOC_CUR),
    )


def knkk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit limits: one area per customer, plus a second area CAN for every
    tenth customer."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    bal = money("c_acctbal")
    main = c.select(
        _str("c_custkey").alias(S.CUST),
        F.when(key % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias(S.AREA),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast(S.MONEY)).otherwise(money(bal * 20)).alias(S.LIMIT),
    )
    extra = c.where(key % 10 == 0).select(
        _str("c_custkey").alias(S.CUST),
        F.lit("CAN").alias(S.AREA),
        money(bal * 10).alias(S.LIMIT),
    )
    return main.unionByName(extra)
