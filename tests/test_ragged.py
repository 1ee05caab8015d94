import csv
import io
import os
import random

import pytest

from ledgerlens.sources import ragged


def _line(fields):
    buf = io.StringIO()
    csv.writer(buf, lineterminator="").writerow(fields)
    return buf.getvalue()


def _repair(spark, lines):
    names = [f"c{i}" for i in range(29)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return [list(r) for r in ragged.repair_ragged_lines(df, names).collect()]


def f(n):
    return [f"f{i}" for i in range(n)]


def test_golden_lines(spark):
    f28 = f(28)
    f28[5] = 'ab",cd"'
    f28q = f(28)
    f28q[5] = 'ab","cd"'
    f27 = f(27)
    f27[5] = 'ab",x,cd"'
    cases = [
        (f(29), f(29)),
        (f(30), f(30)[:6] + f(30)[7:]),
        (f(33), f(33)[:6] + f(33)[10:]),
        (f28, f28[:5] + ["ab", "cd"] + f28[6:]),
        (f28q, f28q[:5] + ["ab", '"cd'] + f28q[6:]),
        (f27, f27[:5] + ["ab", "", "cd"] + f27[6:]),
        (f(26), f(26) + [None, None, None]),
    ]
    got = _repair(spark, [_line(a) for a, _ in cases])
    assert sorted(got, key=str) == sorted([b for _, b in cases], key=str)


def test_blank_line_is_all_nulls_and_bad_lines_rejected(spark):
    no_comma = f(28)
    no_comma[5] = "nocomma"
    assert _repair(spark, [""]) == [[None] * 29]
    assert _repair(spark, [_line(no_comma)]) == []
    df = spark.createDataFrame([(_line(no_comma),)], "value string")
    assert ragged.rejected_ragged_lines(df).count() == 1


def test_read_latin1_file_with_header(spark, tmp_dir):
    header = ["Purchasing_Document_Number", "Item_Number_of_Purchasing_Document"] + [f"h{i}" for i in range(2, 29)]
    row = f(28)
    row[5] = 'Müller",Straße"'
    path = os.path.join(tmp_dir, "ekpo.csv")
    with open(path, "w", encoding="latin-1", newline="") as fh:
        fh.write(_line(header) + "\n" + _line(row) + "\n" + _line(f(29)) + "\n")
    out = ragged.read_ragged_csv(spark, path)
    assert out.columns == header
    rows = sorted((list(r) for r in out.collect()), key=str)
    assert rows == sorted([row[:5] + ["Müller", "Straße"] + row[6:], f(29)], key=str)


def test_blank_cells_kept_or_nulled(spark):
    names = [f"c{i}" for i in range(29)]
    fields = f(29)
    fields[0] = ""
    df = spark.createDataFrame([(_line(fields),)], "value string")
    assert ragged.repair_ragged_lines(df, names).first()["c0"] == ""
    assert ragged.repair_ragged_lines(df, names, blank_as_null=True).first()["c0"] is None


def test_split_equals_csv_module(spark):
    """Unclosed quotes, text behind a closing quote, doubled quotes, control characters."""
    rnd = random.Random(3)
    parts = ["a", "b", '"', ",", '""', " ", "é", "'", "\\", "\x01"]
    lines = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    assert [r[0] for r in ragged.split_csv_lines(df).collect()] == [next(csv.reader([x]), []) for x in lines]


def _write(path, text):
    with open(path, "w", encoding="latin-1", newline="") as fh:
        fh.write(text)


def test_file_keeps_blank_lines_and_control_characters(spark, tmp_dir):
    row = f(29)
    row[3] = "a\x01b"
    path = os.path.join(tmp_dir, "lines.csv")
    _write(path, "\n".join([_line(f(29)), _line(row), "", _line(["x"] * 29)]) + "\n")
    got = sorted((list(r) for r in ragged.read_ragged_csv(spark, path).collect()), key=str)
    assert got == sorted([row, [None] * 29, ["x"] * 29], key=str)


def test_quoted_line_breaks_in_whole_file_mode(spark, tmp_dir):
    row = f(29)
    row[2] = "x\ny, z"
    path = os.path.join(tmp_dir, "breaks.csv")
    _write(path, "\r\n".join([_line(f(29)), _line(row), "", _line(["x"] * 29)]))
    got = sorted((list(r) for r in ragged.read_ragged_csv(spark, path, whole_file=True).collect()), key=str)
    assert got == sorted([row, [None] * 29, ["x"] * 29], key=str)


def test_unusable_header_is_refused(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.csv")
    _write(path, _line(f(28)) + "\n" + _line(f(29)) + "\n")
    with pytest.raises(ValueError, match="header"):
        ragged.read_ragged_csv(spark, path)
