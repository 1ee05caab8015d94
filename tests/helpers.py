"""Small frames for unit tests: the invoice columns the analytics use."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from ledgerlens import schemas as S

INVOICE_SCHEMA = T.StructType(
    [
        T.StructField(S.COMPANY, T.StringType()),
        T.StructField(S.COMPANY_NAME, T.StringType()),
        T.StructField(S.VENDOR, T.StringType()),
        T.StructField(S.DOC, T.StringType()),
        T.StructField(S.LINE, T.IntegerType()),
        T.StructField(S.DOC_TYPE, T.StringType()),
        T.StructField(S.DOC_DATE, T.DateType()),
        T.StructField(S.REF, T.StringType()),
        T.StructField(S.IND, T.StringType()),
        T.StructField(S.AMT_LOC, S.MONEY),
        T.StructField(S.AMT_DOC, S.MONEY),
        T.StructField(S.DOC_CUR, T.StringType()),
        T.StructField(S.LOC_CUR, T.StringType()),
    ]
)

PAIRS_SCHEMA = T.StructType([T.StructField(S.PO_VENDOR, T.StringType()), T.StructField(S.REF, T.StringType())])


def inv(vendor, ref, doc="D1", line=1, doc_type="RE", date=dt.date(2018, 1, 1), amt="10.00", amt_doc=None, ind="H"):
    amt_doc = amt if amt_doc is None else amt_doc
    return (
        "1000", "ACME", vendor, doc, line, doc_type, date, ref, ind,
        Decimal(amt) if amt is not None else None,
        Decimal(amt_doc) if amt_doc is not None else None,
        "USD", "USD",
    )


def invoices(spark, rows):
    return spark.createDataFrame(rows, INVOICE_SCHEMA)


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIRS_SCHEMA)
