"""Run lengths on arrays, ordered lists per group in parts, and mergeable distinct counts."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.arrays import count_consec, list_text
from ledgerlens.operators import payables


def plain_runs(values):
    out = [1]
    for x, y in zip(values, values[1:]):
        if x is not None and y is not None and x == y - 1:
            out[-1] += 1
        else:
            out.append(1)
    return out


def test_count_consec_on_arrays(spark):
    draw = random.Random(2)
    rows = [[1, 4, 5, 6, 7, 9, 19, 21, 22, 23, 24], [], [5], [None], [None, None, 1, 2], [2**31 - 1, -(2**31)], None]
    rows += [[draw.choice([None, *range(6)]) for _ in range(draw.randrange(12))] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, v array<int>")
    got = dict(df.select("k", count_consec("v")).collect())
    assert got[0] == [1, 4, 1, 1, 4]
    assert got == {k: None if v is None else plain_runs(v) for k, v in enumerate(rows)}
    long = spark.range(1).select(F.sequence(F.lit(1), F.lit(50_000)).alias("v"))
    assert long.select(count_consec("v")).first()[0] == [50_000]
    assert spark.createDataFrame([([1, None],)], "v array<int>").select(list_text("v")).first()[0] == "[1, null]"


def sundry(spark, n_hot):
    draw, rows, day = random.Random(4), [], datetime.date(2018, 1, 1)
    for k in range(n_hot):
        rows.append(("hot", str(k), day + datetime.timedelta(days=draw.randrange(360)), 7))
    for v in range(20):
        for k in range(draw.randrange(1, 5)):
            rows.append((f"v{v}", str(1000 + k), day + datetime.timedelta(days=7 * k), draw.choice([1, 2])))
    rows += [(None, "1", day, 1), ("v0", None, day, 1), ("v0", "77", None, 1)]
    df = spark.createDataFrame(rows, f"`{S.VENDOR}` string, `{S.DOC}` string, `{S.DOC_DATE}` date, a int")
    return df.select(S.VENDOR, S.DOC, S.DOC_DATE, F.col("a").cast(S.MONEY).alias(S.AMT_LOC), F.col("a").cast(S.MONEY).alias(S.AMT_DOC))


@pytest.mark.parametrize("max_items", [10_000, 16, 1])
def test_lists_of_a_hot_group_come_in_numbered_parts(spark, max_items):
    df = sundry(spark, 200)
    groups = defaultdict(list)
    for r in df.collect():
        if None not in tuple(r):
            groups[r[0], r[4]].append((int(r[1]), r[2]))
    expected = {}
    for key, docs in groups.items():
        if len(docs) > 1:
            docs.sort()
            expected[key] = ([d.month for _, d in docs], [int(d.strftime("%W")) for _, d in docs])
    got = defaultdict(list)
    for r in payables.recurrence_lists(df, max_items=max_items).collect():
        got[r[S.VENDOR], r[S.AMT_DOC]].append(r)
    assert set(got) == set(expected)
    for key, parts in got.items():
        months, weeks = expected[key]
        parts.sort(key=lambda r: r["part"])
        assert [r["part"] for r in parts] == list(range(parts[0]["parts"])) and len(parts) == -(-len(weeks) // max_items)
        assert all(len(r["week_lists"]) <= max_items for r in parts)
        assert sum((r["month_lists"] for r in parts), []) == months and sum((r["week_lists"] for r in parts), []) == weeks
        runs = plain_runs(weeks)
        assert sum((r["week_times"] for r in parts), []) == runs
        for r in parts:
            assert (r["times"], r["month_count"], r["run_count"], r["max_consecutive_weeks"]) == (len(weeks), len(set(months)), len(runs), max(runs))


def test_sketches_merge_over_any_range(spark):
    day = datetime.date(2018, 1, 1)
    rows = [("big", f"d{k % 30_000}", day + datetime.timedelta(days=k % 50)) for k in range(60_000)]
    rows += [("small", "a", day), ("small", "a", day + datetime.timedelta(days=3)), ("small", "b", None), (None, "x", day), ("none", None, day)]
    df = spark.createDataFrame(rows, f"`{S.VENDOR}` string, `{S.DOC}` string, `{S.DOC_DATE}` date")
    sketches = payables.document_sketches(df)
    assert sketches.count() == 50 + 3
    every = dict(payables.approximate_frequency(sketches).collect())
    exact = dict(payables.invoice_frequency(df).collect())
    assert set(every) == {"big", "small"} and every["small"] == 2 and abs(every["big"] / exact["big"] - 1) < 0.06
    first, last = "2018-01-02", "2018-01-11"
    some = dict(payables.approximate_frequency(sketches, first, last).collect())
    held = {d for v, d, t in rows if v == "big" and datetime.date(2018, 1, 2) <= t <= datetime.date(2018, 1, 11)}
    assert abs(some["big"] / len(held) - 1) < 0.06 and some["small"] == 1
