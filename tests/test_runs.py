import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.runs import POSITION, RUN_INDEX, consecutive_runs, run_lengths


def stretches(values):
    """Lengths of the maximal stretches with step +1: the differences of the places where one begins."""
    steps = [a is not None and b is not None and b - a == 1 for a, b in zip(values, values[1:])]
    begins = [0, *[k for k, goes_on in enumerate(steps, 1) if not goes_on], len(values)]
    return [b - a for a, b in zip(begins, begins[1:])]


def _lengths(spark, groups, partitions=4):
    rows = [(g, i, w) for g, ws in groups.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "g string, pos int, w bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = consecutive_runs(df, ["g"], ["pos"], "w")
        per_run = run_lengths(runs, ["g"], "w").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    got = {}
    for r in sorted(per_run, key=lambda r: (r.g is None, r.g or "", r[RUN_INDEX])):
        got.setdefault(r.g, []).append(r.run_length)
    return got, runs


def test_golden_examples(spark):
    # The worked example and its run lengths come first.
    groups = {
        "doc": [1, 4, 5, 6, 7, 9, 19, 21, 22, 23, 24],
        "repeat": [4, 4, 5],
        "down": [5, 4],
        "year_end": [52, 0],
        "single": [7],
    }
    got, _ = _lengths(spark, groups, 3)
    assert got == {
        "doc": [1, 4, 1, 1, 4],
        "repeat": [1, 2],
        "down": [1, 1],
        "year_end": [1, 1],
        "single": [1],
    }


def test_positions_and_run_index_across_many_partitions(spark):
    # One group spread over many range partitions, plus small groups and missing values and keys.
    rnd = random.Random(7)
    hot, value = [], 0
    for _ in range(3000):
        value = value + 1 if rnd.random() < 0.6 else rnd.randint(0, 60)
        hot.append(value % 54)
    groups = {"hot": hot, "nulls": [1, None, 2, 3, None], None: [1, 2, 4]}
    for g in range(40):
        groups[f"g{g:02d}"] = [rnd.randint(0, 8) for _ in range(rnd.randint(1, 30))]
    got, runs = _lengths(spark, groups, 16)
    assert got == {g: stretches(ws) for g, ws in groups.items()}
    pos = runs.groupBy("g").agg(F.min(POSITION).alias("lo"), F.max(POSITION).alias("hi"), F.count("*").alias("n"))
    for r in pos.collect():
        assert (r.lo, r.hi) == (1, r.n)
    starts = runs.where("is_run_start").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in starts} == {g: len(stretches(ws)) for g, ws in groups.items()}


def test_large_values_are_exact(spark):
    """Whole numbers beyond 2^53, also at the end of their type, in one group over many partitions."""
    base = [0, 1, 2, 3, 4, 6]
    groups = {
        "big": [(1 << 53) + k for k in base],
        "end": [(1 << 63) - 1 - k for k in (2, 1, 0, 0)],
        "many": [(1 << 53) + k + (k // 7) for k in range(500)],
    }
    for partitions in (1, 9):
        got, _ = _lengths(spark, groups, partitions)
        assert got == {g: stretches(ws) for g, ws in groups.items()}
    assert got["big"] == [5, 1]


@pytest.mark.parametrize("seed", range(3))
def test_property_random_groups(spark, seed):
    rnd = random.Random(seed)
    groups = {f"k{i}": [rnd.randint(0, 6) for _ in range(rnd.randint(1, 25))] for i in range(rnd.randint(1, 30))}
    got, _ = _lengths(spark, groups, rnd.randint(1, 9))
    assert got == {g: stretches(ws) for g, ws in groups.items()}
