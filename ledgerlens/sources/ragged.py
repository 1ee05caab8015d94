"""O2: repair the ragged 29-field PO-line extract.

Some lines of the extract have cells merged or extra cells, so their field
count is not 29.  Rules, with ``n`` fields and 0-based positions:

* ``n > 29``: fields 0-5, then the last 23 fields;
* ``n == 28``: fields 0-4, then field 5 split on commas, parts 0 and 1 each
  without their last character, then fields 6...;
* ``n == 27``: fields 0-4, part 0 without its last character, an empty
  field, part 2 without its last character, then fields 6...;
* otherwise unchanged; short lines are padded with nulls.

A 28 / 27-field line whose field 5 has too few commas cannot be repaired (the
original script stops there); such lines are flagged and routed to
``rejected_ragged_lines`` instead of being dropped silently.

Lines are split into cells by native expressions that follow the rules of
Python's ``csv`` module (Spark's CSV parser reads empty cells and text after a
closing quote differently, and the field count is what the rules key on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.sources.records import BLOCK, FILE, file_lines, has_open_lines, records, without_headers

FIELDS = "fields"

# Column names of the stand-in PO-line extract (29 fields).
PO_LINE_COLUMNS = [S.PO_NUM, S.PO_ITEM] + [f"Field_{i:02d}" for i in range(2, S.EKPO_FIELD_COUNT)]

# A cell and the comma behind it, in a line with a comma put behind it: quoted with text after the closing
# quote, plain, or empty; or quoted and never closed, up to the end.
_CELL = r'(?s)(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),|"[^"]*+(?:""[^"]*+)*+\z'
# The quoted part of a cell, and what follows the closing quote.
_QUOTED = r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"?(.*)\z'


def _cell(match: Column) -> Column:
    """The content of a cell as matched, with its comma."""
    raw = match.substr(F.lit(1), F.length(match) - 1)
    inside = F.replace(F.regexp_extract(raw, _QUOTED, 1), F.lit('""'), F.lit('"'))
    return F.when(raw.startswith('"'), F.concat(inside, F.regexp_extract(raw, _QUOTED, 2))).otherwise(raw)


def split_csv_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """One ``array<string>`` of CSV fields per line (the rules of Python's csv module); a blank line
    has none, a null line gives null.  Lines without a quote are simply split."""
    line = F.col(col)
    cells = F.transform(F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(_CELL), F.lit(0)), _cell)
    fields = (
        F.when(line == "", F.array().cast("array<string>"))
        .when(line.contains('"'), cells)
        .when(line.isNotNull(), F.split(line, ",", -1))
    )
    return lines.select(fields.alias(FIELDS))


def _drop_last_char(c: Column) -> Column:
    return c.substr(F.lit(1), F.length(c) - 1)


# What the rules need of a line: its fields, how far its later fields are moved, and the parts of a merged field 5.
_REPAIR = "_repair"


def _prepared(fields: DataFrame, width: int) -> tuple[DataFrame, Column]:
    """``_repair`` of every line of field arrays, and whether no rule can repair the line."""
    f = F.col(FIELDS)
    n = F.size(f)
    merged = n.isin(width - 1, width - 2)
    rows = fields.select(
        F.struct(
            f.alias("f"),
            F.coalesce(n, F.lit(0)).alias("n"),
            F.when(n >= width - 2, n - width).otherwise(0).alias("moved"),
            F.when(merged, F.split(F.try_element_at(f, F.lit(6)), ",")).alias("parts"),
        ).alias(_REPAIR)
    )
    r = F.col(_REPAIR)
    needed = F.when(r["n"] == width - 1, 2).when(r["n"] == width - 2, 3)
    return rows, F.coalesce(F.size(r["parts"]) < needed, F.lit(False))


def _cells(width: int) -> list[Column]:
    """The repaired fields of ``_repair``, one column each; fields that a short line lacks are null."""
    r = F.col(_REPAIR)
    n, two, three = r["n"], F.col(_REPAIR)["n"] == width - 1, F.col(_REPAIR)["n"] == width - 2

    def part(i: int) -> Column:
        text = F.get(r["parts"], F.lit(i))
        return text.substr(F.lit(1), F.length(text) - 1)

    def cell(i: int) -> Column:
        plain = F.get(r["f"], F.lit(i) if i < 6 else r["moved"] + i)
        if i == 5:
            return F.when(two | three, part(0)).otherwise(plain)
        if i == 6:
            return F.when(two, part(1)).when(three, F.lit("")).otherwise(plain)
        return F.when(three, part(2)).otherwise(plain) if i == 7 else plain

    return [cell(i) for i in range(width)]


def repair_ragged_lines(
    lines: DataFrame, column_names: list[str], col: str = "value", blank_as_null: bool = False
) -> DataFrame:
    """Repaired rows, one string column per name; unrepairable lines are left out
    (see ``rejected_ragged_lines``).

    Empty cells stay ``''`` (so a blank PO key does not match the null keys of
    the other extracts, as in the original); ``blank_as_null=True`` turns them
    into nulls instead.  A line is split once: lines that cannot be repaired are
    left out by a generator, since the optimizer would put the whole split into
    a filter once more for every place that uses it.
    """
    width = len(column_names)
    rows, bad = _prepared(split_csv_lines(lines, col), width)
    rows = rows.select(F.explode(F.when(~bad, F.array(_REPAIR))).alias(_REPAIR))
    cells = _cells(width)
    if blank_as_null:
        cells = [F.when(c != "", c) for c in cells]
    return rows.select([c.alias(name) for c, name in zip(cells, column_names)])


def rejected_ragged_lines(lines: DataFrame, width: int = S.EKPO_FIELD_COUNT, col: str = "value") -> DataFrame:
    """The lines the rules cannot repair, with their parsed fields."""
    rows, bad = _prepared(split_csv_lines(lines, col), width)
    return rows.select(F.explode(F.when(bad, F.array(_REPAIR))).alias(_REPAIR)).select(F.col(_REPAIR)["f"].alias(FIELDS))


def read_lines(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", header: bool = True, whole_file: bool | None = None
) -> DataFrame:
    """Raw records of CSV files as one ``value`` column, decoded with ``encoding``.

    Files are split into blocks and read in parallel; blank lines are kept.
    Where quoted cells hold line breaks, records are put together over lines
    and blocks (``sources.records``); ``whole_file`` says so (or that there are
    none) without looking.  With ``header`` the lines at the beginning of files
    that equal the first line of the first file are left out.
    """
    lines = file_lines(spark, path, encoding)
    if has_open_lines(lines) if whole_file is None else whole_file:
        found = records(lines)
        return without_headers(found) if header else found.orderBy(FILE, F.desc("_first")).select("value")
    if header:
        first = lines.first()
        if first is not None:
            lines = lines.where((F.col(BLOCK) > 0) | (F.col("value") != first["value"]))
    return lines.select("value")


def header_names(
    spark: SparkSession, path: str, width: int = S.EKPO_FIELD_COUNT, encoding: str = "ISO-8859-1", whole_file: bool | None = None
) -> list[str]:
    """Column names from the first record of the first file, repaired by the same rules.

    A header that is missing or cannot be repaired raises ``ValueError``.
    """
    first = read_lines(spark, path, encoding=encoding, header=False, whole_file=whole_file).limit(1)
    rows, bad = _prepared(split_csv_lines(first), width)
    row = rows.select(bad.alias("bad"), F.col(_REPAIR)["f"].alias(FIELDS), F.array(*_cells(width)).alias("names")).first()
    if row is None or row["bad"] or not row[FIELDS]:
        raise ValueError(f"no usable header line in {path}: {row and row[FIELDS]}")
    return [f"_c{i}" if name is None else name for i, name in enumerate(row["names"])]


def read_ragged_csv(
    spark: SparkSession,
    path: str,
    width: int = S.EKPO_FIELD_COUNT,
    encoding: str = "ISO-8859-1",
    blank_as_null: bool = False,
    whole_file: bool | None = None,
) -> DataFrame:
    """Read and repair a ragged extract: header names, then repaired rows (blank lines as rows of nulls)."""
    if whole_file is None:
        whole_file = has_open_lines(file_lines(spark, path, encoding))
    names = header_names(spark, path, width, encoding, whole_file)
    lines = read_lines(spark, path, encoding=encoding, header=True, whole_file=whole_file)
    return repair_ragged_lines(lines, names, blank_as_null=blank_as_null)


# ------------------------------------------------------------ stand-in extract


def _po_line_fields(li: DataFrame) -> list[Column]:
    """The first ten fields of a stand-in PO line, as strings, from a line item."""
    k = F.col("l_orderkey")
    ln = F.col("l_linenumber")
    fields = [
        k.cast("string"),
        ln.cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_quantity").cast("int").cast("string"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")),
        F.when(ln % 4 == 2, F.lit("")).otherwise(F.col("l_shipdate").cast("date").cast("string")),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        F.col("l_discount").cast("decimal(4,2)").cast("string"),
        F.col("l_tax").cast("decimal(4,2)").cast("string"),
    ]
    return fields


def po_lines_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw extract lines derived from every line item, damaged the way the
    real extract is: by line number mod 4, 1 -> cells 5 and 6 merged (28
    fields), 2 -> cells 5-7 merged with an empty middle (27 fields), 3 ->
    1-4 extra cells after cell 5 (30-33 fields), 0 -> intact.  Of the merged
    ones those of orders 5 mod 64 have lost parts of the cell, which no rule
    can repair.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    numbers = F.sequence(F.lit(10), F.lit(S.EKPO_FIELD_COUNT - 1))
    tail = F.transform(numbers, lambda i: F.concat(F.lit("v"), ((k * i + line) % 97).cast("string")))
    fl = li.select(
        *[c.alias(f"f{i}") for i, c in enumerate(_po_line_fields(li))],
        F.array_join(tail, ",").alias("tail"),
        (line % 4).alias("_kind"),
        (k % 4 + 1).cast("int").alias("_extra"),
        (k % 64 == 5).alias("_lost"),
    )
    f = [F.col(f"f{i}") for i in range(10)]
    kind, q, lost = F.col("_kind"), F.lit('"'), F.col("_lost")
    extra = F.array_join(F.array_repeat(F.lit("x"), F.col("_extra")), ",")
    # Fields 5 to 7 as each kind of damage leaves them.
    middle = (
        F.when((kind == 1) & lost, F.concat_ws(",", f[5], f[7]))
        .when((kind == 2) & lost, F.concat(q, f[5], F.lit(',x"')))
        .when(kind == 1, F.concat(q, f[5], F.lit('"",'), f[6], F.lit('""",'), f[7]))
        .when(kind == 2, F.concat(q, f[5], F.lit('"",x,'), f[7], F.lit('"""')))
        .when(kind == 3, F.concat_ws(",", f[5], extra, f[6], f[7]))
        .otherwise(F.concat_ws(",", f[5], f[6], f[7]))
    )
    return fl.select(F.concat_ws(",", *f[:5], middle, f[8], f[9], "tail").alias("value"))
