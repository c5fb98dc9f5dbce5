"""Fits that leave a row per term in a registry, failed specifications included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.regression import FIT_SCHEMA, Fit, fit
from terrapanel.sources.writers import append_registry


def recorded_fit(df: DataFrame, path: str, spec: str, y: str, xs: list[str], note: str = "", **options) -> Fit:
    """Run :func:`fit`, append its rows to the registry at ``path`` and return it; a failure is recorded, then raised."""
    spark = df.sparkSession

    def save(rows: list[tuple], status: str) -> None:
        table = spark.createDataFrame(rows, FIT_SCHEMA)
        append_registry(table.withColumns({"status": F.lit(status), "note": F.lit(note)}), path)

    try:
        result = fit(df, y, xs, **options)
    except Exception as error:
        save([(spec, x, *[None] * 10) for x in xs], f"FAILED: {type(error).__name__}")
        raise
    save(result.rows(spec), "ok")
    return result
