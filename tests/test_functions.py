import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import (
    age_bucket,
    full_outer_nullsafe,
    ne_keep_null,
    not_in_keep_null,
    nullsafe_join,
    outstanding_days,
    week_of_year_monday,
)


def test_week_of_year_golden(spark):
    # FIXTURES C: %W, Monday first, week 0 before the first Monday.
    cases = {
        dt.date(2018, 1, 1): 1,
        dt.date(2017, 1, 1): 0,
        dt.date(2018, 12, 31): 53,
        dt.date(2016, 1, 3): 0,
        dt.date(2016, 1, 4): 1,
    }
    df = spark.createDataFrame([(d,) for d in cases], "d date")
    got = {r.d: r.w for r in df.select("d", week_of_year_monday("d").alias("w")).collect()}
    assert got == cases


def test_week_of_year_matches_strftime_every_day(spark):
    start = dt.date(1990, 1, 1)
    days = (dt.date(2050, 12, 31) - start).days + 1
    df = spark.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    got = df.select("d", week_of_year_monday("d").alias("w")).collect()
    bad = [(r.d, r.w) for r in got if int(r.d.strftime("%W")) != r.w]
    assert len(got) == days and bad == []


def test_ne_keep_null_keeps_missing_values(spark):
    df = spark.createDataFrame([("ZP",), ("KZ",), ("RE",), (None,)], "t string")
    assert sorted(df.where(ne_keep_null("t", "ZP")).collect(), key=str) == sorted(
        [("KZ",), ("RE",), (None,)], key=str
    )
    kept = [r.t for r in df.where(not_in_keep_null("t", ["ZP", "KZ"])).collect()]
    assert sorted(kept, key=str) == sorted(["RE", None], key=str)
    # plain != would drop the null row
    assert df.where(F.col("t") != "ZP").count() == 2


def test_nullsafe_join_matches_null_to_null(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), (None, "y")], "k string, w string")
    out = {(r.k, r.w) for r in nullsafe_join(left, right, ["k"], "left").collect()}
    assert out == {("a", "x"), (None, "y")}
    assert nullsafe_join(left, right, ["k"], "left_anti").count() == 0
    assert nullsafe_join(left, right, ["k"], "left").columns == ["k", "v", "w"]


def test_full_outer_nullsafe_merges_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), (None, "y"), ("c", "z")], "k string, w string")
    out = {tuple(r) for r in full_outer_nullsafe(left, right, ["k"]).collect()}
    assert out == {("a", 1, "x"), (None, 2, "y"), ("b", 3, None), ("c", None, "z")}


def test_age_bucket_boundaries(spark):
    # FIXTURES C, as_of 2018-12-01.
    cases = [
        (0, dt.date(2017, 1, 1), 0, "not outstanding"),
        (-5, dt.date(2017, 1, 1), 0, "not outstanding"),
        (10, dt.date(2018, 12, 1), 0, "not outstanding"),
        (10, dt.date(2018, 11, 30), 1, "< 60"),
        (10, dt.date(2018, 10, 3), 59, "< 60"),
        (10, dt.date(2018, 10, 2), 60, "60-90"),
        (10, dt.date(2018, 9, 2), 90, "60-90"),
        (10, dt.date(2018, 9, 1), 91, "90-120"),
        (10, dt.date(2018, 8, 3), 120, "90-120"),
        (10, dt.date(2018, 8, 2), 121, "> 120"),
        (10, dt.date(2019, 1, 1), -31, None),
        (10, None, None, None),
    ]
    df = spark.createDataFrame([(b, d) for b, d, _, _ in cases], "b int, d date")
    out = df.select(outstanding_days("b", "d", "2018-12-01").alias("days"))
    out = out.select("days", age_bucket("days").alias("bucket")).collect()
    assert [(r.days, r.bucket) for r in out] == [(c[2], c[3]) for c in cases]
