"""Sinks. Every writer leaves one directory of part files; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_ordered(df: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """Globally ordered by ``keys``: ranges across files, sorted inside each, so key filters skip files.

    All keys bound the ranges, so one heavy leading key still spans several files.
    """
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).option("compression", "zstd").parquet(path)


def append_registry(rows: DataFrame, path: str) -> None:
    """Add specification rows to a registry directory; earlier rows stay."""
    rows.write.mode("append").option("compression", "zstd").parquet(path)
