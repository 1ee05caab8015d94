"""Report sinks.

Reports are written by the executors in parallel, one file per partition
(never gathered into one task or through the driver).  CSV carries a header
and no row-index column; Parquet keeps the types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
    return path
