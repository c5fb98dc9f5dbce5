"""Descriptive tables: distributions, tails, movements, growth and concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions import expressions as X
from terrapanel.operators import grid
from terrapanel.operators.joins import attach, with_scalars
from terrapanel.operators.quantiles import exact_quantiles, long_values, quantile_bins


def group_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *by)


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None,
             probs: dict[str, float] | None = None) -> DataFrame:
    """count, mean, sd, min, max and chosen quantiles per (by, variable)."""
    by = by or []
    long = long_values(df, by, columns)
    keys = [*by, "variable"]
    base = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                   F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    return attach(base, exact_quantiles(long, keys, "value", probs or {"p25": 0.25, "median": 0.5, "p75": 0.75}), keys)


def global_stats(df: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """Two versions of one measure: counts, gap moments, share within tolerance."""
    gap = F.col(a) - F.col(b)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(gap).alias("n_both"), F.avg(gap).alias("mean_diff"),
                  F.stddev_samp(gap).alias("sd_diff"), F.avg((F.abs(gap) <= tolerance).cast("double")).alias("share_within"))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, tail quantiles, zero share, skew, excess kurtosis and Jarque-Bera per column."""
    long = long_values(df, [], columns)
    v = F.col("value")
    base = long.groupBy("variable").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("excess_kurtosis"), F.avg((v == 0).cast("double")).alias("share_zero"))
    n, s, k = F.col("n"), F.col("skew"), F.col("excess_kurtosis")
    jb = n / 6.0 * (s * s + k * k / 4.0)
    base = base.withColumns({"jb": jb, "jb_p": F.exp(-jb / 2.0),
                             "skew_sample": s * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))})
    q = exact_quantiles(long, ["variable"], "value", {"p1": .01, "p25": .25, "median": .5, "p75": .75, "p99": .99})
    return attach(base, q, ["variable"])


def upper_tail(df: DataFrame, value: str, probs: list[float]) -> DataFrame:
    names = {f"q{i}": p for i, p in enumerate(probs)}
    row = exact_quantiles(df, [], value, names)
    pairs = F.array(*[F.struct(F.lit(p).alias("quantile"), F.col(n).alias("value")) for n, p in names.items()])
    return row.select(F.inline(pairs))


def top_rows(df: DataFrame, value: str, key: list[str], k: int) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), *key).limit(k)


def modal_share(df: DataFrame, value: str) -> DataFrame:
    """Share of rows holding the single most common value (a failed-merge detector)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_values"), F.max("c").alias("top_n"),
                      (F.max("c") / F.sum("c")).alias("top_share"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cell counts with row shares (a transition matrix in long form)."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("__t"))
    return attach(cells, rows, [a]).withColumn("row_share", F.col("n") / F.col("__t")).drop("__t")


def movement(df: DataFrame, a: str, b: str, top: int) -> DataFrame:
    move = F.abs(F.col(a) - F.col(b))
    return df.where(move.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg((move > 0).cast("double")).alias("share_changed"),
        F.avg((move >= 2).cast("double")).alias("share_two_or_more"),
        F.avg(F.when(F.col(a) == top, (F.col(b) == top).cast("double"))).alias("top_stays_top"))


def standardised_difference(df: DataFrame, low: Column, columns: list[str]) -> DataFrame:
    """Mean of flagged rows against the rest over the pooled SD, one row per column."""
    long = long_values(df.withColumn("__low", low), ["__low"], columns)
    yes, no = F.when(F.col("__low"), F.col("value")), F.when(~F.col("__low"), F.col("value"))
    s = long.groupBy("variable").agg(F.avg(yes).alias("mean_low"), F.avg(no).alias("mean_rest"),
                                     F.var_samp(yes).alias("__v1"), F.var_samp(no).alias("__v0"), F.count(yes).alias("n_low"))
    pooled = F.sqrt((F.col("__v1") + F.col("__v0")) / 2.0)
    return s.select("variable", "mean_low", "mean_rest", "n_low",
                    ((F.col("mean_low") - F.col("mean_rest")) / F.nullif(pooled, F.lit(0.0))).alias("std_mean_diff"))


def threshold_exposure(df: DataFrame, count: str, entity: str, thresholds: list[int], window: Column) -> DataFrame:
    """Per threshold: rows below, their share, entities ever below, share inside the window."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("r"), F.count_if(window).alias("w"), *[
        a for t in thresholds for a in (F.count_if(F.col(count) < t).alias(f"b{t}"),
                                        F.count_if((F.col(count) < t) & window).alias(f"bw{t}"))])
    tot = per.agg(F.sum("r").alias("r"), F.sum("w").alias("w"), *[
        a for t in thresholds for a in (F.sum(f"b{t}").alias(f"b{t}"), F.sum(f"bw{t}").alias(f"bw{t}"), F.count_if(F.col(f"b{t}") > 0).alias(f"e{t}"))])
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"b{t}").alias("n_below"),
                              (F.col(f"b{t}") / F.col("r")).alias("share_below"), F.col(f"e{t}").alias("n_entities_ever"),
                              (F.col(f"bw{t}") / F.col("w")).alias("share_below_window")) for t in thresholds])
    return tot.select(F.inline(rows))


def persistence_of_zero(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    lagged = df.withColumn("__p", F.lag(value).over(grid.along(entity, period)))
    return lagged.where(F.col("__p").isNotNull()).agg(
        F.avg(F.when(F.col("__p") == 0, (F.col(value) == 0).cast("double"))).alias("p_zero_after_zero"),
        F.avg(F.when(F.col("__p") > 0, (F.col(value) == 0).cast("double"))).alias("p_zero_after_positive"))


def decile_profile(df: DataFrame, entity: str, value: str, attributes: list[str], k: int = 10) -> DataFrame:
    """Entities binned on their mean of ``value``; bin means of value and attributes."""
    means = df.groupBy(entity).agg(F.avg(value).alias("__m"), *[F.max(a).alias(a) for a in attributes])
    binned = quantile_bins(means, [], "__m", k, "bin")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_entities"), F.avg("__m").alias(f"mean_{value}"),
                                     *[F.avg(a).alias(f"mean_{a}") for a in attributes])


def restricted_moments(df: DataFrame, columns: list[str], restrictions: dict[str, Column], weight: str | None = None) -> DataFrame:
    """Weighted mean and SD of columns under each restriction, all in one aggregate."""
    labels = F.array(*[F.when(cond, F.lit(name)) for name, cond in restrictions.items()])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    tagged = df.withColumn("__w", w).withColumn("restriction", F.explode(F.array_compact(labels)))
    long = long_values(tagged, ["restriction", "__w"], columns)
    s = long.where(F.col("value").isNotNull()).groupBy("restriction", "variable").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("__w") * F.col("value")) / F.sum("__w")).alias("mean"),
        (F.sum(F.col("__w") * F.col("value") * F.col("value")) / F.sum("__w")).alias("__m2"))
    return s.withColumn("sd", F.sqrt(F.greatest(F.col("__m2") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("__m2")


def weight_share(df: DataFrame, by: str, weight: str, out: str) -> DataFrame:
    g = df.groupBy(by).agg(F.sum(F.col(weight).cast("double")).alias("__w"))
    return with_scalars(g, g.agg(F.sum("__w").alias("__t"))).select(by, (F.col("__w") / F.col("__t")).alias(out))


def variance_parts(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Overall, between and within SD per variable and the within share of variance."""
    long = long_values(df, [entity], columns).where(F.col("value").isNotNull())
    means = long.groupBy("variable", entity).agg(F.avg("value").alias("__m"))
    between = means.groupBy("variable").agg(F.stddev_samp("__m").alias("between_sd"))
    dev = F.col("value") - F.col("__m")
    parts = attach(long, means, ["variable", entity]).groupBy("variable").agg(
        F.stddev_samp("value").alias("overall_sd"), F.stddev_samp(dev).alias("within_sd"),
        X.ratio(F.var_samp(dev), F.var_samp("value")).alias("within_share"))
    return attach(parts, between, ["variable"])


def yearly_series(df: DataFrame, period: str, level: str, count: str) -> DataFrame:
    base = df.groupBy(period).agg(F.avg(level).alias("mean_level"), F.stddev_samp(level).alias("sd_level"),
                                  F.sum(count).alias("total"), F.avg((F.col(count) > 0).cast("double")).alias("share_any"))
    return attach(base, exact_quantiles(df, [period], level, {"p10": .1, "median_level": .5, "p90": .9}), [period])


def evaluation_grid(df: DataFrame, x: str, probs: list[float], z_values: list[float]) -> DataFrame:
    """Treatment percentiles crossed with moderator z-scores."""
    z = F.explode(F.array(*[F.lit(float(v)) for v in z_values]))
    return upper_tail(df, x, probs).withColumnRenamed("value", "x_value").select("quantile", "x_value", z.alias("z"))


def cell_sizes(df: DataFrame, x: Column, y: Column, cell: float, cuts: list[tuple[float, str]], last: str) -> DataFrame:
    """Events grouped by snapped grid cell, banded by the number of events in their cell."""
    cells = df.groupBy(X.snap(x, cell).alias("gx"), X.snap(y, cell).alias("gy")).agg(F.count(F.lit(1)).alias("cell_n"))
    banded = cells.withColumn("size_band", X.band(F.col("cell_n"), cuts, last))
    return banded.groupBy("size_band").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("cell_n").alias("n_events"))


def conditional_zero_share(df: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """Groups with any row, and the share of them in which no row passes ``test``."""
    per = df.groupBy(*keys).agg(F.count_if(test).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("k") == 0).alias("n_zero"),
                   F.avg((F.col("k") == 0).cast("double")).alias("share_zero"))


def fiscal_to_calendar(df: DataFrame, year: str, value: str, out: str) -> DataFrame:
    """A quarter of the fiscal year ending in the year plus three quarters of the one starting in it."""
    nxt = df.select((F.col(year) - 1).alias(year), F.col(value).alias("__next"))
    return df.join(nxt, year).withColumn(out, 0.25 * F.col(value) + 0.75 * F.col("__next")).drop("__next")
