"""Entity-by-period panels: dense grid, explicit zeros, lags, leads and base-year indices.

Windows here run over one row per (entity, period), so a partition is bounded by the number of periods.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_grid(entities: DataFrame, entity: str, period: str, first: int, last: int,
               lookback: int = 0) -> DataFrame:
    years = F.explode(F.sequence(F.lit(first - lookback), F.lit(last)))
    return entities.select(entity).distinct().withColumn(period, years)


def fill_grid(grid: DataFrame, counts: DataFrame, keys: list[str], zero: list[str]) -> DataFrame:
    """Left join onto the grid; count columns become explicit zeros, other measures stay NULL."""
    return grid.join(counts, keys, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def along(entity: str, period: str) -> Window:
    return Window.partitionBy(entity).orderBy(period)


def add_lags(df: DataFrame, entity: str, period: str, columns: list[str], ks: list[int],
             leads: bool = False) -> DataFrame:
    w, fn, tag = along(entity, period), (F.lead if leads else F.lag), ("lead" if leads else "lag")
    return df.withColumns({f"{c}_{tag}{k}": fn(c, k).over(w) for c in columns for k in ks})


def add_previous_sum(df: DataFrame, column: str, k: int, out: str, entity: str, period: str) -> DataFrame:
    w = along(entity, period)
    parts = [F.coalesce(F.lag(column, i).over(w), F.lit(0)) for i in range(1, k + 1)]
    return df.withColumn(out, reduce(Column.__add__, parts))


def add_difference(df: DataFrame, column: str, out: str, entity: str, period: str) -> DataFrame:
    return df.withColumn(out, F.col(column) - F.lag(column).over(along(entity, period)))


def add_running_sum(df: DataFrame, column: str, out: str, entity: str, period: str) -> DataFrame:
    w = along(entity, period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(column).over(w))


def add_base_index(df: DataFrame, column: str, out: str, group: str, period: str, base: int) -> DataFrame:
    """Value minus the group's own value in the base period."""
    w = Window.partitionBy(group)
    return df.withColumn(out, F.col(column) - F.max(F.when(F.col(period) == base, F.col(column))).over(w))


def keep_periods(df: DataFrame, period: str, first: int, last: int) -> DataFrame:
    return df.where(F.col(period).between(first, last))


def growth_between(df: DataFrame, entity: str, period: str, column: str, first: int, last: int,
                   out: str) -> DataFrame:
    """One row per entity: start, end and their difference (one conditional aggregate)."""
    at = {y: F.max(F.when(F.col(period) == y, F.col(column))) for y in (first, last)}
    return df.groupBy(entity).agg(at[first].alias("start_value"), at[last].alias("end_value"),
                                  (at[last] - at[first]).alias(out))
