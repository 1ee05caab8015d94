"""Typed readers for the ERP CSV extracts (BSAK, T001, LFA1, RSEG, EKBE, BSID, KNKK).

Every file is read with its header, all cells as text (no schema inference,
so key columns keep their leading zeros), then the columns the analytics
name are read as whole numbers, money and dates in the forms ERP extracts
write them.  A named column that a file lacks is an error, as is a missing
file.  A cell that cannot be read becomes null, and ``rejects`` lists it,
together with records whose number of cells does not fit the header.  Other
columns stay text.  Both files' ``Currency_Key`` columns are renamed on read,
so the invoice (document) and company (local) currencies never collide in a
join.

Files are read in parallel, in blocks, also where quoted cells hold line breaks
(``sources.records``).

The PO-line extract is ragged and has its own reader in
``ledgerlens.sources.ragged``.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schemas as S
from ledgerlens.sources.records import VALUE, file_lines, first_record, has_open_lines, records, without_headers

# Date patterns tried in order for text dates.
DATE_PATTERNS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]",
    "M/d/yyyy",
    "M/d/yyyy HH:mm:ss",
    "M/d/yy",
    "yyyyMMdd",
    "d.M.yyyy",
    "d-MMM-yyyy",
    "d-MMM-yy",
)

LATIN1 = "ISO-8859-1"
CORRUPT = "_corrupt_record"
REJECT_COLUMNS = "file string, kind string, column string, value string"


def parse_date(col: Column, patterns=DATE_PATTERNS) -> Column:
    """First pattern that parses; null when none does."""
    return F.coalesce(*[F.try_to_date(F.trim(col), p) for p in patterns])


def parse_number(col: Column) -> Column:
    """A number with all its digits: thousands separators and a trailing minus are understood."""
    text = F.trim(col)
    grouped = text.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?-?$")
    text = F.when(grouped, F.regexp_replace(text, ",", "")).otherwise(text)
    behind = text.rlike(r"^\d[\d.]*-$")
    text = F.when(behind, F.concat(F.lit("-"), F.regexp_replace(text, "-", ""))).otherwise(text)
    return text.try_cast("decimal(38,10)")


def parse_money(col: Column) -> Column:
    """An amount in the library's money type; further decimals are rounded half up (and listed as rejects)."""
    return F.round(parse_number(col), 2).try_cast(S.MONEY)


def _parsed(name: str, col: Column, dtype: T.DataType, date_patterns) -> Column:
    if name == S.DOC_DATE:
        return parse_date(col, date_patterns)
    if isinstance(dtype, T.DecimalType):
        return parse_money(col)
    return col if isinstance(dtype, T.StringType) else F.trim(col).try_cast(dtype)


def read_csv_text(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """All columns as text under the header's names, and ``_corrupt_record``: the text of a record
    whose number of cells does not fit the header (its cells are kept as far as they fit).

    Files are read in parallel, also where quoted cells hold line breaks;
    ``multi_line`` says whether some do, without looking.
    """
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # A record is checked against all its cells.
    reader = spark.read.options(header=True, inferSchema=False, encoding=encoding, columnPruning=False, **options)
    if multi_line is None:
        multi_line = has_open_lines(file_lines(spark, path, encoding))
    if not multi_line:
        fields = [T.StructField(c, T.StringType()) for c in [*reader.csv(path).columns, CORRUPT]]
        return reader.option("enforceSchema", True).schema(T.StructType(fields)).csv(path)
    found = records(file_lines(spark, path, encoding))
    top = first_record(found)
    if top is None:
        raise ValueError(f"no header line in {path}")
    names = next(csv.reader([top[VALUE]]))
    names = [n or f"_c{i}" for i, n in enumerate(names)]
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, CORRUPT])
    rows = without_headers(found, top).where(F.trim(VALUE) != "")
    return rows.select(F.from_csv(F.col(VALUE), ddl, options).alias("r")).select("r.*")


def typed(raw: DataFrame, fields: dict[str, T.DataType], rename: dict[str, str] | None = None,
          date_patterns=DATE_PATTERNS) -> DataFrame:
    """Read the named columns as their types, keep the rest as text, then rename.

    A named column that is missing raises ``ValueError``.
    """
    rename = rename or {}
    missing = [name for name in fields if name not in raw.columns]
    if missing:
        raise ValueError(f"the extract lacks the columns {missing}; it has {raw.columns}")
    cols = [_parsed(name, F.col(f"`{name}`"), t, date_patterns).alias(rename.get(name, name)) for name, t in fields.items()]
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in fields and c != CORRUPT]
    return raw.select(*cols, *rest)


# The typed columns of each extract, what is renamed, and its encoding.
EXTRACTS = {
    "bsak": (S.BSAK_FIELDS, {S.CURRENCY: S.DOC_CUR}, "UTF-8"),
    "t001": (S.T001_FIELDS, {S.CURRENCY: S.LOC_CUR}, "UTF-8"),
    "lfa1": (S.LFA1_FIELDS, {}, "UTF-8"),
    "rseg": (S.RSEG_FIELDS, {}, "UTF-8"),
    "ekbe": (S.EKBE_FIELDS, {}, "UTF-8"),
    "bsid": (S.BSID_FIELDS, {S.CURRENCY: S.DOC_CUR}, LATIN1),
    "knkk": (S.KNKK_FIELDS, {}, "UTF-8"),
}


def read_extract(spark: SparkSession, kind: str, path: str, encoding: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """The typed rows of an extract of the given kind."""
    fields, rename, default = EXTRACTS[kind]
    return typed(read_csv_text(spark, path, encoding or default, multi_line), fields, rename)


def read_bsak(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """Cleared vendor invoice lines (BSAK + BKPF)."""
    return read_extract(spark, "bsak", path, encoding, multi_line)


def read_t001(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """Company codes: name and local currency."""
    return read_extract(spark, "t001", path, encoding, multi_line)


def read_lfa1(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """Vendor master."""
    return read_extract(spark, "lfa1", path, encoding, multi_line)


def read_rseg(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """Invoice receipt lines (RSEG + RBKP)."""
    return read_extract(spark, "rseg", path, encoding, multi_line)


def read_ekbe(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """PO history."""
    return read_extract(spark, "ekbe", path, encoding, multi_line)


def read_bsid(spark: SparkSession, path: str, encoding: str = LATIN1, multi_line: bool | None = None) -> DataFrame:
    """Open customer items (BSID + BKPF), latin-1 by default."""
    return read_extract(spark, "bsid", path, encoding, multi_line)


def read_knkk(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """Customer credit limits per credit control area."""
    return read_extract(spark, "knkk", path, encoding, multi_line)


def rejects(raw: DataFrame, fields: dict[str, T.DataType], file: str, date_patterns=DATE_PATTERNS) -> DataFrame:
    """file, kind, column and value of what ``typed`` could not take over as it is.

    Kinds: ``cell`` (not readable, read as null), ``rounded`` (more decimals
    than money has) and ``record`` (the number of cells does not fit).
    """
    found = []
    for name, dtype in fields.items():
        if name not in raw.columns or (isinstance(dtype, T.StringType) and name != S.DOC_DATE):
            continue
        c = F.col(f"`{name}`")
        parsed = _parsed(name, c, dtype, date_patterns)
        kind = F.when(c.isNotNull() & (F.trim(c) != "") & parsed.isNull(), "cell")
        if isinstance(dtype, T.DecimalType):
            kind = kind.when(parsed != parse_number(c), "rounded")
        found.append(F.struct(kind.alias("kind"), F.lit(name).alias("column"), c.alias("value")))
    if CORRUPT in raw.columns:
        kind = F.when(F.col(CORRUPT).isNotNull(), "record")
        # Spark reads the record's text only together with some other column.
        text = F.when(F.col(f"`{raw.columns[0]}`").isNotNull(), F.col(CORRUPT)).otherwise(F.col(CORRUPT))
        found.append(F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("column"), text.alias("value")))
    if not found:
        return raw.sparkSession.createDataFrame([], REJECT_COLUMNS)
    rows = raw.select(F.explode(F.array(*found)).alias("r")).where("r.kind is not null")
    return rows.select(F.lit(file).alias("file"), "r.kind", "r.column", "r.value")


def unparsed_values(raw: DataFrame, fields: dict[str, T.DataType], date_patterns=DATE_PATTERNS) -> DataFrame:
    """Data-quality count: per typed column, the cells that ``rejects`` lists.  One row, one partial
    aggregation over the file."""
    cells = rejects(raw.drop(CORRUPT), fields, "", date_patterns)
    names = [n for n, t in fields.items() if n in raw.columns and (not isinstance(t, T.StringType) or n == S.DOC_DATE)]
    return cells.agg(*[F.count(F.when(F.col("column") == n, 1)).alias(n) for n in names])
