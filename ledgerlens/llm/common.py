"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import string
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Table = TypeVar("Table")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact name and the first one where a name repeats.

    Other columns may have any name, also ones that differ from these only in
    case or that an operator uses inside.
    """
    at = [df.columns.index(n) for n in names]
    by_place = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return by_place.select([F.col(f"_in{i}").alias(n) for i, n in zip(at, names)])


def semi_join_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``df``, all columns as they are, whose ``column`` is among ``ids`` (null matches null)."""
    at, width = df.columns.index(column), len(df.columns)
    by_place = df.toDF(*[f"_in{i}" for i in range(width)])
    wanted = ids.select(F.col(column).alias("_wanted"))
    return by_place.join(wanted, F.col(f"_in{at}").eqNullSafe(F.col("_wanted")), "left_semi").toDF(*df.columns)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that tell rows of different id or text apart, also null ids from others and null texts from empty ones."""
    held = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("="), text), F.lit("")))
    return F.substring(F.unhex(F.sha2(held.cast("binary"), 256)), 1, 16)


def semi_join_rows(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``df``, all columns as they are, whose row key is among the ``row_key`` of ``keys``."""
    by_place = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    key = row_key(*[F.col(f"_in{df.columns.index(c)}") for c in ("doc_id", "text")])
    wanted = keys.select(F.col("row_key").alias("_wanted"))
    return by_place.join(wanted, key == F.col("_wanted"), "left_semi").toDF(*df.columns)


def once(df: DataFrame, *columns: str) -> DataFrame:
    """One of the rows that agree in the named columns, all columns as they are."""
    by_place = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return by_place.dropDuplicates([f"_in{df.columns.index(c)}" for c in columns]).toDF(*df.columns)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of a batch that goes to a Python worker, and Spark's setting for it.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes, unless the session has a bound of its own.

    Spark's 10,000 rows of documents are tens of MB, which each task holds in the executor's native memory (twice
    while a vector grows) and again in its Python worker.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def release_memory() -> None:
    """Freed memory goes back to the system, since an idle worker otherwise keeps the most that it ever used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are unpacked at once.  Memory is released at the end, and at the
    beginning what the task before still held at its end."""
    release_memory()
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
    batch = None
    release_memory()


def _worker_tables() -> dict:
    """A dictionary that lives as long as the Python worker."""
    import sys
    import types

    return vars(sys.modules.setdefault("_corpus_worker_tables", types.ModuleType("_corpus_worker_tables"))).setdefault("held", {})


def drop_worker_tables() -> None:
    """What an earlier operator left in this Python worker goes."""
    held = _worker_tables()
    if held:
        held.clear()
        release_memory()


def worker_table(key: object, build: Callable[[], Table]) -> Table:
    """The table of this key, built once in a Python worker (from a broadcast).

    A worker holds one table: it goes from stage to stage, and would otherwise
    keep those of all operators that ever ran in it.
    """
    held = _worker_tables()
    if key not in held:
        drop_worker_tables()
        held[key] = build()
    return held[key]
