"""Projection, filtering, funnel counts and outlier trimming of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.joins import all_of, attach, with_scalars
from terrapanel.operators.quantiles import exact_quantiles
from terrapanel.session import materialise


def lenient_projection(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rename and cast; ``columns`` maps output name to (source, type). Bad text becomes NULL."""
    return df.select(*[F.col(src).try_cast(kind).alias(out) for out, (src, kind) in columns.items()])


def keep_category_if_present(df: DataFrame, column: str, value: str) -> DataFrame:
    """Keep only ``value`` when it occurs anywhere, otherwise pass every row through."""
    flag = df.agg(F.coalesce(F.bool_or(F.col(column) == value), F.lit(False)).alias("__seen"))
    return with_scalars(df, flag).where(~F.col("__seen") | (F.col(column) == value)).drop("__seen")


def valid_measures(df: DataFrame, minima: dict[str, float], strict: bool = True) -> DataFrame:
    """Rows whose measures are present, numbers, and above (``strict``) or at least the given minimum."""
    kinds = dict(df.dtypes)
    tests = [((F.col(c) > lo) if strict else (F.col(c) >= lo)) & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)) for c, lo in minima.items()]
    return df.where(all_of(tests))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows surviving each successive filter, counted in one pass."""
    aggs, so_far = [], F.lit(True)
    for i, test in enumerate(steps.values()):
        so_far = so_far & F.coalesce(test, F.lit(False))
        aggs.append(F.count_if(so_far).alias(f"__s{i}"))
    counts = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("step_no"), F.lit(name).alias("step"),
                              F.col(f"__s{i}").alias("rows")) for i, name in enumerate(steps)])
    return counts.select(F.inline(rows))


def trim_within(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """Drop values outside the group's own [low, high] quantiles (bounds are kept)."""
    # written first, so that their size is known and the rows are not shuffled by group
    bounds = materialise(exact_quantiles(df, by, value, {"__lo": low, "__hi": high}))
    return (attach(df, bounds, by, "inner")
            .where(F.col(value).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi"))


def winsorise(df: DataFrame, value: str, high: float, out: str) -> DataFrame:
    cap = exact_quantiles(df, [], value, {"__cap": high})
    capped = F.when(F.col(value).isNotNull(), F.least(F.col(value), F.col("__cap")))
    return with_scalars(df, cap).withColumn(out, capped).drop("__cap")


def trim_above(df: DataFrame, value: str, high: float) -> DataFrame:
    cap = exact_quantiles(df, [], value, {"__cap": high})
    return with_scalars(df, cap).where(F.col(value) <= F.col("__cap")).drop("__cap")


def low_count_flags(df: DataFrame, count: str, thresholds: list[int]) -> DataFrame:
    return df.withColumns({f"{count}_under_{t}": (F.col(count) < t).cast("int") for t in thresholds})


def window_flags(df: DataFrame, year: str, first: int, last: int, baseline: list[str],
                 analysis: list[str]) -> DataFrame:
    """Study-window flag and two completeness flags."""
    inside = F.col(year).between(first, last)
    base_ok = all_of([F.col(c).isNotNull() for c in baseline])
    all_ok = all_of([F.col(c).isNotNull() for c in analysis])
    return df.withColumns({"main_sample": inside, "baseline_complete": base_ok,
                           "analysis_complete_case": base_ok & all_ok})


def groups_with_two(df: DataFrame, group: str, entity: str, window: str | None = None) -> DataFrame:
    """Estimation sample: optional window flag, then groups with at least two distinct entities."""
    base = df.where(F.col(window)) if window else df
    many = (base.groupBy(group).agg((F.min(entity) < F.max(entity)).alias("__many"))
            .where("__many").select(group))
    return base.join(many, group, "left_semi")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def deflate(df: DataFrame, index: DataFrame, keys: list[str], index_col: str, value: str,
            out: str) -> DataFrame:
    """Divide by a price index (base 100) on period keys; unmatched periods stay NULL."""
    return (df.join(index.select(*keys, index_col), keys, "left")
            .withColumn(out, F.col(value) / (F.nullif(F.col(index_col).cast("double"), F.lit(0.0)) / 100.0)))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n_distinct) through value-level grouping, so no per-column set is built."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value").where(F.col("value").isNotNull())
    values = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("rows"))
    return values.groupBy("variable").agg(F.count(F.lit(1)).alias("n_distinct"))


def numeric_columns(df: DataFrame, contains: str | None = None) -> list[str]:
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes
            if (t in kinds or t.startswith("decimal")) and (contains is None or contains in c)]
