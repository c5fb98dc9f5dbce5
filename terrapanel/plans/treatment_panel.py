"""Counts on a dense entity-by-year grid, normalised and lagged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.expressions import rate_per
from terrapanel.operators import grid


def treatment_panel(counts: DataFrame, base: DataFrame, entity: str, year: str, count: str, denominator: str,
                    first: int, last: int, lookback: int = 3) -> DataFrame:
    """Dense grid with ``lookback`` earlier years, explicit zeros, rate per 1,000, lags 1..3 and their sum.

    Lookback years are dropped at the end, so the first study year already has complete lags.
    """
    cells = grid.dense_grid(base, entity, year, first, last, lookback)
    full = grid.fill_grid(cells, counts, [entity, year], [count]).join(base.select(entity, denominator), entity, "left")
    full = full.withColumn("rate", rate_per(F.col(count), F.col(denominator)))
    ks = list(range(1, lookback + 1))
    lagged = grid.add_lags(full, entity, year, [count, "rate"], ks)
    for c in (count, "rate"):
        lagged = grid.add_previous_sum(lagged, c, lookback, f"{c}_prev{lookback}", entity, year)
    return grid.keep_periods(lagged, year, first, last)
