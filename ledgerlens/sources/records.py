"""CSV records from files read in parallel, also where quoted cells hold line breaks.

Spark splits a file into blocks and hands out the lines that begin in each.  A
line whose quoted cell is still open goes on in the next one, so whether a line
begins a record depends on everything before it.  But a line can only do four
things to the state "inside a quoted cell": leave it, flip it, set it or clear
it.  Such functions compose associatively, so the state before every line is a
prefix scan: first inside each block, for both states the block may begin in,
then over one row per block and file.  A block is scanned by the task that reads
it.  Records are put together there; only those that go over the end of a block
(or of the rows a scan gets at once) are shuffled, by the position of their
first line.

Lines follow the rules of Python's ``csv`` module: a quote opens a cell only at
its beginning, doubled quotes stay inside, text may follow a closing quote, an
open cell at the end of a file ends there.  Line breaks inside cells are ``\\n``
whatever the file has; one at the very end of a file is not part of an open cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize

VALUE, FILE, BLOCK, AT = "value", "_file", "_block", "_at"

# Whole cells with their commas, then a quoted cell that is not closed.
_UNCLOSED = r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+"[^"]*+(?:""[^"]*+)*+\z'
# What opens from outside a cell; and what stays open, or closes and opens again, from inside.
_OPENS = r"(?s)\A" + _UNCLOSED
_STAYS = r'(?s)\A[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,' + _UNCLOSED + ")"


def file_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines of text files with their file, the block they begin in and a number that grows inside a block."""
    # The text source hands bytes on as they are, so they can be decoded here.
    return spark.read.text(path).select(
        F.decode(F.col("value").cast("binary"), encoding).alias(VALUE),
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(AT),
    )


def open_after(line: Column) -> tuple[Column, Column]:
    """Whether a quoted cell is open behind the line, if none (if one) was open before it."""
    quoted = line.contains('"')
    return quoted & line.rlike(_OPENS), ~quoted | line.rlike(_STAYS)


def has_open_lines(lines: DataFrame) -> bool:
    """Whether a line ends inside a quoted cell; without one every line is a record."""
    return not lines.where(open_after(F.col(VALUE))[0]).isEmpty()


def _scan(rows: DataFrame, z: str, o: str, parts: list[str], order: str) -> DataFrame:
    """Add ``_flips`` and ``_base``: the state before a row is (coalesce(_base, first state) + _flips) mod 2.

    ``_base`` comes from the last row before that sets or clears the state, and
    is null where there is none; ``_flips`` counts the rows before that flip it.
    """
    here = Window.partitionBy(*parts).orderBy(order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.col(z) & ~F.col(o)).cast("long")
    upto = F.sum(flip).over(here.rowsBetween(Window.unboundedPreceding, 0))
    base = F.when(F.col(z) == F.col(o), (F.col(z).cast("long") + upto) % 2)
    return rows.withColumn("_set", base).withColumn("_flips", F.coalesce(F.sum(flip).over(before), F.lit(0))).withColumn(
        "_base", F.last("_set", ignorenulls=True).over(before)
    )


def _state(first: Column) -> Column:
    return (F.coalesce(F.col("_base"), first) + F.col("_flips")) % 2 == 1


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For lines in their order: what ``records`` needs to know of each, if none (if a cell) was open where its block begins.

    Where both come to the same, and a record begins and ends among the lines
    at hand, its lines are put together at once and count as one closed line.
    """
    at_block = None
    for batch in batches:
        files, blocks = batch.column(1), batch.column(2).to_numpy()
        new = (blocks[1:] != blocks[:-1]) | pc.not_equal(files.slice(1), files.slice(0, max(0, len(files) - 1))).to_numpy(False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if at_block != (at_block := (files[begin].as_py(), blocks[begin])):
                is_open, record = [False, True], [-1, -1]
            part = batch.slice(begin, end - begin)
            at, (z, o) = part.column(3).to_numpy(), (part.column(k).to_numpy(False) for k in (4, 5))
            place = np.arange(len(at))
            flips = np.cumsum(z & ~o)
            last_set = np.maximum.accumulate(np.where(z == o, place, -1))
            before, begun = [], []
            for s in (0, 1):
                after = np.where(last_set >= 0, z[last_set] ^ ((flips - flips[last_set]) % 2 == 1), is_open[s] ^ (flips % 2 == 1))
                before.append(np.append(is_open[s], after[:-1]))
                first = np.maximum.accumulate(np.where(before[s], -1, place))
                begun.append(np.where(first >= 0, at[first], record[s]))
                is_open[s], record[s] = bool(after[-1]), int(begun[s][-1])
                ended = after if s == 0 else ended | after
            # Whole records from the first line that begins one in either case to the last that ends one after it.
            starts, ends = np.flatnonzero(~(before[0] | before[1])), np.flatnonzero(~ended) + 1
            ends = ends[ends > starts[0]] if len(starts) else ends[:0]
            top, rest = (int(starts[0]), int(ends[-1])) if len(ends) else (len(at), len(at))
            firsts = np.append(top, ends[:-1])[: len(ends)]
            value = part.column(0).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, rest), pa.int32()), value)
            kept = np.concatenate([place[:top], firsts, place[rest:]]).astype(np.int64)
            joined = np.repeat([False, True, False], [top, len(firsts), len(at) - rest])
            facts = [z[kept] & ~joined, o[kept] & ~joined, *(before[s][kept] for s in (0, 1))]
            records_of = [pa.array(begun[s][kept], mask=begun[s][kept] < 0) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([value.slice(0, top), pc.binary_join(lists, "\n"), value.slice(rest)]),
                    part.column(1).take(pa.array(kept)).cast(pa.string()),
                    pa.array(blocks[begin:end][kept]),
                    pa.array(at[kept]),
                    *map(pa.array, facts),
                    *records_of,
                ],
                names=[c.split()[0] for c in _SCANNED.split(", ")],
            )


_SCANNED = (
    f"{VALUE} string, {FILE} string, {BLOCK} long, {AT} long, _z boolean, _o boolean, "
    "_open0 boolean, _open1 boolean, _rec0 long, _rec1 long"
)


def records(lines: DataFrame) -> DataFrame:
    """value, ``_file`` and ``_first`` (the file's first record) of the CSV records in ``file_lines``.

    The lines are scanned where they are read and written once with what they
    do to the state, or as whole records; only lines of records that go over
    the end of a block, or of the rows scanned at once, are shuffled.
    """
    z, o = open_after(F.col(VALUE))
    # Many small files or blocks go to as many tasks, and written files, as a shuffle would; a task reads them in order.
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select(VALUE, FILE, BLOCK, AT, z.alias("_z"), o.alias("_o")).coalesce(tasks)
    rows = materialize(rows.mapInArrow(_scanned, _SCANNED), "csv-lines")
    after = lambda c: F.when(F.col(c), F.col("_o")).otherwise(F.col("_z"))
    blocks = rows.groupBy(FILE, BLOCK).agg(
        F.max_by(after("_open0"), AT).alias("_end0"), F.max_by(after("_open1"), AT).alias("_end1"),
        F.max("_rec0").alias("_last0"), F.max("_rec1").alias("_last1"), F.min(AT).alias("_top"),
    )
    blocks = _scan(blocks, "_end0", "_end1", [FILE], BLOCK).withColumn("_inside", _state(F.lit(0)))
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("_inside"), F.col("_last1")).otherwise(F.col("_last0"))
    blocks = blocks.withColumn("_last", last).select(
        FILE, BLOCK, "_inside", "_top", F.last("_last", ignorenulls=True).over(before).alias("_carried")
    )
    # One row per block: no more than the list of tasks that read the files.  Joined otherwise, all lines are shuffled.
    rows = rows.join(F.broadcast(materialize(blocks, "csv-blocks")), [FILE, BLOCK])
    is_open = F.when(F.col("_inside"), F.col("_open1")).otherwise(F.col("_open0"))
    begun = F.when(F.col("_inside"), F.col("_rec1")).otherwise(F.col("_rec0"))
    rows = rows.select(
        VALUE, FILE, AT, is_open.alias("_open"), F.coalesce(begun, "_carried").alias("_rec"),
        F.when(is_open, F.col("_o")).otherwise(F.col("_z")).alias("_more"),
        ((F.col(BLOCK) == 0) & (F.col(AT) == F.col("_top"))).alias("_first"),
    )
    whole = rows.where("not _open and not _more").select(VALUE, FILE, "_first")
    pieces = rows.where("_open or _more").groupBy("_rec").agg(
        F.array_sort(F.collect_list(F.struct(AT, VALUE))).alias("_lines"), F.first(FILE).alias(FILE), F.max("_first").alias("_first")
    )
    joined = pieces.select(F.array_join(F.transform("_lines", lambda x: x[VALUE]), "\n").alias(VALUE), FILE, "_first")
    return whole.unionByName(joined)


def first_record(found: DataFrame) -> Row | None:
    """The ``value`` of the first record of the first file that is not empty."""
    return found.where("_first").orderBy(FILE).select(VALUE).first()


def without_headers(found: DataFrame, top: Row | None = None) -> DataFrame:
    """The ``value`` of records without the files' first ones that equal that of the first file (``top``, if known)."""
    top = top or first_record(found)
    if top is not None:
        found = found.where(~F.col("_first") | (F.col(VALUE) != top[VALUE]))
    return found.select(VALUE)
