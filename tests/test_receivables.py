import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from ledgerlens import schemas as S
from ledgerlens.operators import receivables as R

BSID = T.StructType(
    [
        T.StructField(S.COMPANY, T.StringType()),
        T.StructField(S.CUST, T.StringType()),
        T.StructField(S.REF, T.StringType()),
        T.StructField(S.IND, T.StringType()),
        T.StructField(S.AMT_LOC, S.MONEY),
        T.StructField(S.DOC_DATE, T.DateType()),
    ]
)
KNKK = T.StructType(
    [T.StructField(S.CUST, T.StringType()), T.StructField(S.AREA, T.StringType()), T.StructField(S.LIMIT, S.MONEY)]
)
T001 = T.StructType(
    [T.StructField(S.COMPANY, T.StringType()), T.StructField(S.COMPANY_NAME, T.StringType()), T.StructField(S.LOC_CUR, T.StringType())]
)
AS_OF = "2018-12-01"


def d(s):
    return dt.date.fromisoformat(s)


def _bsid(spark, rows):
    return spark.createDataFrame([(c, k, r, i, Decimal(a) if a else None, d(x) if x else None) for c, k, r, i, a, x in rows], BSID)


def test_balances_single_pass(spark):
    bsid = _bsid(spark, [
        ("10", "C1", "R1", "S", "100.00", "2018-08-01"),
        ("10", "C1", "R1", "H", "30.00", "2018-09-15"),
        ("10", "C1", "R1", "X", "999.00", "2018-07-01"),   # other indicator: not summed, but its date counts
        ("10", "C1", "R2", "X", "50.00", "2018-01-01"),    # no S / H item: no balance row
        ("10", "C1", "R3", "H", "20.00", "2018-01-01"),    # credit balance: 0 days
        ("10", None, "R4", "S", "5.00", "2018-01-01"),     # null customer: no row
    ])
    got = {r[S.REF]: r for r in R.document_balances(bsid, as_of=AS_OF, fan_out=False).collect()}
    assert set(got) == {"R1", "R3"}
    r1 = got["R1"]
    assert (r1.Amount_S, r1.Amount_H, r1.Balance) == (Decimal("100.00"), Decimal("30.00"), Decimal("70.00"))
    assert r1[S.DOC_DATE] == d("2018-07-01") and r1.outstanding_days == 153 and r1.type == "> 120"
    assert (got["R3"].Balance, got["R3"].outstanding_days, got["R3"].type) == (Decimal("-20.00"), 0, "not outstanding")


def test_credit_area_fan_out_both_ways(spark):
    bsid = _bsid(spark, [("10", "C1", "R1", "S", "100.00", "2018-08-01"), ("10", "C2", "R9", "S", "1.00", "2018-08-01")])
    knkk = spark.createDataFrame([("C1", "US01", Decimal("50.00")), ("C1", "CAN", Decimal("60.00"))], KNKK)
    fan = {r[S.CUST]: r.Balance for r in R.document_balances(bsid, knkk, as_of=AS_OF).collect()}
    plain = {r[S.CUST]: r.Balance for r in R.document_balances(bsid, knkk, as_of=AS_OF, fan_out=False).collect()}
    assert fan == {"C1": Decimal("200.00"), "C2": Decimal("1.00")}
    assert plain == {"C1": Decimal("100.00"), "C2": Decimal("1.00")}


def test_credit_limit_labels(spark):
    bsid = _bsid(spark, [
        ("10", "A", "R1", "S", "100.00", "2018-08-01"),
        ("10", "B", "R2", "S", "100.00", "2018-08-01"),
        ("10", "C", "R3", "S", "100.00", "2018-08-01"),
    ])
    knkk = spark.createDataFrame([("A", "US01", Decimal("99.00")), ("B", "US01", Decimal("100.00")), ("C", "US01", None)], KNKK)
    got = {r[S.CUST]: r.above_limit for r in R.credit_limit_status(bsid, knkk, as_of=AS_OF).collect()}
    assert got == {"A": "above limit", "B": "below limit", "C": "no limit"}


def test_aging_by_customer(spark):
    bsid = _bsid(spark, [
        ("10", "C1", "R1", "S", "100.00", "2018-09-20"),   # 72 days -> 60-90
        ("20", "C1", "R2", "S", "40.00", "2018-08-20"),    # 103 days -> 90-120
        ("10", "C1", "R3", "S", "7.00", "2018-11-20"),     # < 60: not in the report
        ("10", "C2", "R4", "S", "5.00", "2017-01-01"),     # > 120, customer only in CAN
        ("10", "C3", "R5", "S", "8.00", "2017-01-01"),     # no credit row: area null, kept
    ])
    knkk = spark.createDataFrame([("C1", "US01", Decimal("500.00")), ("C2", "CAN", Decimal("1.00"))], KNKK)
    t001 = spark.createDataFrame([("10", "Ten", "USD"), ("20", "Twenty", "CAD")], T001)
    out = R.ar_aging_by_customer(bsid, knkk, t001, as_of=AS_OF)
    assert out.columns == S.TASK5_COLUMNS
    rows = sorted((tuple(r) for r in out.collect()), key=str)
    assert rows == sorted([
        ("C1", "10", "Ten", Decimal("140.00"), "USD", Decimal("500.00"), Decimal("100.00"), Decimal("40.00"), Decimal("0.00")),
        ("C1", "20", "Twenty", Decimal("140.00"), "CAD", Decimal("500.00"), Decimal("100.00"), Decimal("40.00"), Decimal("0.00")),
        ("C3", "10", "Ten", Decimal("8.00"), "USD", None, Decimal("0.00"), Decimal("0.00"), Decimal("8.00")),
    ], key=str)
