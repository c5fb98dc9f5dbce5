"""Star merge of attribute tables onto a panel, and its hard stops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def merge_star(panel: DataFrame, tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left-join every (table, keys) in order; each table must be unique on its keys.

    No hints: AQE broadcasts a table whose size it has measured to be small.
    """
    return reduce(lambda left, part: left.join(part[0], part[1], "left"), tables, panel)


def regression_slice(sales: DataFrame, attributes: DataFrame, panel: DataFrame, area: str, year: str,
                     sale_columns: list[str], attribute_columns: list[str], panel_columns: list[str]) -> DataFrame:
    """Transaction-level rows carrying their area's attributes and its panel values of the year."""
    rows = sales.select(*sale_columns).where(f"{area} IS NOT NULL")
    return merge_star(rows, [(attributes.select(area, *attribute_columns), [area]), (panel.select(area, year, *panel_columns), [area, year])])
