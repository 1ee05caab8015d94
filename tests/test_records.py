"""CSV records over lines and file blocks against Python's csv module."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import erp, ragged
from ledgerlens.sources.records import BLOCK, file_lines, has_open_lines, records, without_headers


@pytest.fixture()
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _write(path, text, encoding="latin-1"):
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)


def _fields(df):
    return sorted(map(tuple, (r[0] for r in ragged.split_csv_lines(df).collect())))


def _expected(text):
    return sorted(map(tuple, csv.reader(io.StringIO(text.replace("\r\n", "\n").removesuffix("\n")))))


@pytest.mark.parametrize("seed", range(4))
def test_records_of_random_files_equal_csv_module(small_blocks, tmp_dir, seed):
    """Any characters: quotes inside plain cells, text behind closing quotes, cells that never close."""
    draw = random.Random(seed)
    pieces = ["a", "bc", '"', '"', ",", ",", '""', "\n", "\r\n" if seed % 2 else "\n", " ", "é"]
    text = "".join(draw.choice(pieces) for _ in range(900)) + "z"
    path = os.path.join(tmp_dir, "any.csv")
    _write(path, text)
    lines = file_lines(small_blocks, path)
    assert lines.select(BLOCK).distinct().count() > 8 and has_open_lines(lines)
    assert _fields(records(lines)) == _expected(text)


def test_wellformed_file_of_many_blocks(small_blocks, tmp_dir):
    draw = random.Random(8)
    cells = ["plain", 'with "quotes"', "two\nlines", "a, b", "", "\n", "x" * 90, "many\n" * 30]
    rows = [["id", "one", "two"]] + [[str(i), draw.choice(cells), draw.choice(cells)] for i in range(300)]
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    for k in (1, 2):  # two files with the same header
        _write(os.path.join(tmp_dir, f"part{k}.csv"), out.getvalue(), "utf-8")
    lines = file_lines(small_blocks, tmp_dir, "UTF-8")
    assert lines.select(BLOCK).distinct().count() > 100
    assert _fields(without_headers(records(lines))) == sorted(map(tuple, rows[1:] * 2))
    read = erp.read_csv_text(small_blocks, tmp_dir)
    assert read.columns == ["id", "one", "two", erp.CORRUPT]
    got = sorted(tuple(x or "" for x in r[:3]) for r in read.collect())
    assert got == sorted(map(tuple, rows[1:] * 2)) and read.where(F.col(erp.CORRUPT).isNotNull()).count() == 0


def test_file_without_line_breaks_in_cells_stays_lines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "plain.csv")
    _write(path, 'a,"b ""c""",5" pipe\n"x","y",z\n')
    assert not has_open_lines(file_lines(spark, path))
    assert [r[0] for r in ragged.read_lines(spark, path, header=False).collect()] == ['a,"b ""c""",5" pipe', '"x","y",z']


def test_header_is_dropped_only_at_the_top(small_blocks, tmp_dir):
    path = os.path.join(tmp_dir, "h.csv")
    _write(path, 'h,k\n1,"x\ny"\nh,k\n2,z\n')
    assert sorted(r[0] for r in ragged.read_lines(small_blocks, path).collect()) == ['1,"x\ny"', "2,z", "h,k"]


def test_empty_and_blank_files(small_blocks, tmp_dir):
    _write(os.path.join(tmp_dir, "e.csv"), "")
    assert records(file_lines(small_blocks, tmp_dir)).count() == 0
    _write(os.path.join(tmp_dir, "b.csv"), '\n\n"\n\n"\n')
    assert sorted(r[0] for r in records(file_lines(small_blocks, tmp_dir)).collect()) == ["", "", '"\n\n"']


def test_records_are_dealt_by_block_and_joined_by_key(small_blocks, tmp_dir):
    """No task reads a whole file: windows are per block, and per file only over one row a block."""
    path = os.path.join(tmp_dir, "p.csv")
    _write(path, "".join(f'{i},"a\nb"\n' for i in range(400)))
    assert file_lines(small_blocks, path).rdd.getNumPartitions() > 20
    got = records(file_lines(small_blocks, path))
    assert got.count() == 400 and got.where("value not like '%a\nb%'").count() == 0


def test_only_records_over_the_end_of_a_block_are_shuffled(spark, tmp_dir):
    """Lines are put together where they are read: one written row a record, but for those cut by the rows of a batch."""
    from ledgerlens import session

    path = os.path.join(tmp_dir, "r.csv")
    text = "".join(f'{i},"a ""b""\n\nc",{i}\n{i},plain,"x"\n' for i in range(400)) + '9,"open\n'
    _write(path, text)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            found = records(file_lines(spark, path))
            written = next(p for p in reversed(session._written[spark.sparkContext.applicationId]) if "/csv-lines-" in p)
            # Besides the records two more lines of the first one, which may as well go on from a block before.
            assert spark.read.parquet(written).count() == 803 or rows == "7"
            assert _fields(found) == _expected(text) and found.where("_first").count() == 1
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
