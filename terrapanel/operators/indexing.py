"""Area attributes and composite indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions import expressions as X
from terrapanel.operators import ranks
from terrapanel.operators.joins import all_of, attach, with_scalars
from terrapanel.operators.quantiles import (exact_quantiles, long_values, value_ranks,
                                            with_average_ranks, with_value_ranks)


def long_to_wide(df: DataFrame, key: str, category: str, value: str, columns: dict[str, str]) -> DataFrame:
    """One row per key, one summed column per listed category; absent combinations are zero."""
    return df.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(F.col(category) == cat, F.col(value))), F.lit(0)).alias(out)
        for cat, out in columns.items()])


def grouped_shares(df: DataFrame, groups: dict[str, list[str]], prefix: str, total: str) -> DataFrame:
    """Sum fine bands into coarse groups and express each as a share of all bands."""
    bands = [b for members in groups.values() for b in members]
    if len(set(bands)) != len(bands):
        raise ValueError("a band belongs to two groups")
    out = df.withColumn(total, X.row_sum(bands))
    return out.withColumns({f"{prefix}{g}": X.ratio(X.row_sum(m), F.col(total)) for g, m in groups.items()})


def interactions(df: DataFrame, x: str, moderators: list[str]) -> DataFrame:
    return df.withColumns({f"{x}_{m}": F.col(x) * F.col(m) for m in moderators})


def add_zscores(df: DataFrame, columns: dict[str, str], ddof: int = 1, over: DataFrame | None = None) -> DataFrame:
    """Global z-scores; moments come from one row aggregated over ``over`` (default ``df``)."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    stats = (over if over is not None else df).agg(
        *[a for c in columns for a in (F.avg(c).alias(f"__m_{c}"), sd(c).alias(f"__s_{c}"))])
    out = with_scalars(df, stats).withColumns({
        z: (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) for c, z in columns.items()})
    return out.drop(*[f"__{k}_{c}" for c in columns for k in ("m", "s")])


def add_median_flag(df: DataFrame, value: str, out: str, above: bool = False) -> DataFrame:
    med = exact_quantiles(df, [], value, {"__med": 0.5})
    test = F.col(value) > F.col("__med") if above else F.col(value) < F.col("__med")
    return with_scalars(df, med).withColumn(out, test.cast("int")).drop("__med")


def rank_domains(df: DataFrame, scores: list[str], key: str, source: str = "score",
                 published: dict[str, str] | None = None) -> DataFrame:
    """(key, domain, rank, n): published rank columns, or scores re-ranked (1 = highest)."""
    if source not in ("score", "published"):
        raise ValueError(f"rank source must be 'score' or 'published', got {source!r}")
    cols = scores if source == "score" else [published[s] for s in scores]
    long = long_values(df, [key], cols, "domain", "value")
    if source == "published":
        names = F.create_map(*[F.lit(x) for s in scores for x in (published[s], s)])
        n = df.agg(F.count(F.lit(1)).alias("n"))
        return with_scalars(long.select(key, names[F.col("domain")].alias("domain"), F.col("value").alias("rank")), n)
    ranked = with_value_ranks(long, ["domain"], "value", descending=True)
    return ranked.select(key, "domain", F.col("rank_min").alias("rank"), F.col("group_n").alias("n"))


def transformed_domains(ranked: DataFrame, key: str, domains: list[str], constant: float = 23.0,
                        top: float = 100.0) -> DataFrame:
    """Exponential transform of every domain rank, one column per domain."""
    score = X.exponential_score(X.scaled_rank(F.col("rank"), F.col("n")), constant, top)
    long = ranked.withColumn("__s", score)
    return long.groupBy(key).agg(*[F.max(F.when(F.col("domain") == d, F.col("__s"))).alias(d) for d in domains])


def blends(df: DataFrame, variants: dict[str, tuple[dict[str, float], bool]]) -> DataFrame:
    """One column per variant: (weights by column, rescale to one)."""
    return df.withColumns({name: X.weighted_blend(w, rescale) for name, (w, rescale) in variants.items()})


def add_decile(df: DataFrame, value: str, out: str, k: int = 10) -> DataFrame:
    """ceil(k*rank/n) with rank 1 the highest value and ties sharing the best rank."""
    ranked = value_ranks(df, [], value, descending=True)
    tiles = ranked.select(value, F.ceil(F.col("rank_min") * F.lit(float(k)) / F.col("group_n")).cast("long").alias(out))
    return attach(df, tiles, [value])


def weighted_rollup(df: DataFrame, parent: str, columns: list[tuple[str, str, str]]) -> DataFrame:
    """Weighted means in one aggregate; each entry is (output, value, weight).

    A group whose weights total zero or less stops the job when its row is computed.
    """
    sums = df.groupBy(parent).agg(*[a for out, v, w in columns for a in (
        F.sum(F.col(v).cast("double") * F.col(w)).alias(f"__n_{out}"),
        F.sum(F.col(w).cast("double")).alias(f"__d_{out}"))])

    def mean(out: str) -> Column:
        den = F.col(f"__d_{out}")
        bad = F.raise_error(F.concat(F.lit(f"non-positive weight total for {out} in group "), F.col(parent).cast("string")))
        return F.when(den > 0, F.col(f"__n_{out}") / den).otherwise(bad.cast("double")).alias(out)

    return sums.select(parent, *[mean(out) for out, _, _ in columns])


def weighted_share(df: DataFrame, parent: str, flag: Column, weight: str, out: str) -> DataFrame:
    w = F.col(weight).cast("double")
    return df.groupBy(parent).agg(
        X.ratio(F.sum(F.when(flag, w).otherwise(0.0)), F.sum(w)).alias(out))


def weighting_sensitivity(df: DataFrame, parent: str, value: str, weight: str) -> DataFrame:
    """Weighted against plain group means: largest gap and correlation."""
    v, w = F.col(value), F.col(weight).cast("double")
    means = df.groupBy(parent).agg((F.sum(v * w) / F.sum(w)).alias("a"), F.avg(v).alias("b"))
    return means.agg(F.count(F.lit(1)).alias("n_groups"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"),
                     F.corr("a", "b").alias("correlation"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two measures of one quantity: Pearson, Spearman, largest and mean gap, share identical."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    r = with_average_ranks(both, [], ["__a", "__b"], "__rank")
    gap = F.abs(F.col("__a") - F.col("__b"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.corr("__a", "__b").alias("pearson"),
                 F.corr("__rank__a", "__rank__b").alias("spearman"), F.max(gap).alias("max_abs_diff"),
                 F.avg(gap).alias("mean_abs_diff"), F.avg((F.col("__a") == F.col("__b")).cast("double")).alias("share_identical"))


def require_agreement(df: DataFrame, a: str, b: str, min_spearman: float, max_gap: float) -> DataFrame:
    """Stop when a recomputed column strays from its published counterpart."""
    row = agreement(df, a, b).first()
    if row["spearman"] is None or row["spearman"] < min_spearman or row["max_abs_diff"] > max_gap:
        raise ValueError(f"{a} does not reproduce {b}: {row.asDict()}")
    return df


def build_moderators(df: DataFrame, key: str, value: str, prefix: str, high_is_poor: bool) -> DataFrame:
    """Value, z-score, quartile, poor-quartile and poor-half flags, direction label.

    The poor flags keep their meaning whichever way the source measure points.
    """
    out = ranks.with_tile(df.withColumn(f"{prefix}_value", F.col(value)), f"{prefix}_value", key, 4,
                          f"{prefix}_quartile", "spread")
    out = add_zscores(out, {f"{prefix}_value": f"{prefix}_z"})
    poor = 4 if high_is_poor else 1
    out = out.withColumn(f"{prefix}_poor", (F.col(f"{prefix}_quartile") == poor).cast("int"))
    out = add_median_flag(out, f"{prefix}_value", f"{prefix}_poor_half", above=high_is_poor)
    label = "higher = more deprived" if high_is_poor else "higher = richer"
    return out.withColumn(f"{prefix}_direction", F.lit(label))


def persistence(linked: DataFrame, key: str, old: str, new: str, by: list[str]) -> DataFrame:
    """Two-vintage comparison per stratum: correlations, percentile change, quartile moves."""
    d = linked.where(all_of([F.col(old).isNotNull(), F.col(new).isNotNull()]))
    d = with_average_ranks(d, by, [old, new], "__rank_")
    for col, tag in ((old, "o"), (new, "n")):
        d = ranks.with_tile(d, col, key, 4, f"__{tag}_q", "rank_bin", by)
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__group_n"))
    d = attach(d, sizes, by)
    pct = F.abs(F.col(f"__rank_{old}") - F.col(f"__rank_{new}")) / F.col("__group_n")
    move = F.abs(F.col("__o_q") - F.col("__n_q"))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr(old, new).alias("pearson"),
        F.corr(f"__rank_{old}", f"__rank_{new}").alias("spearman"), F.avg(pct).alias("mean_abs_percentile_change"),
        F.avg((move == 0).cast("double")).alias("same_quartile"),
        F.avg((move >= 2).cast("double")).alias("moved_two_or_more"))


def density_attributes(df: DataFrame, population: str, households: str, area_ha: str) -> DataFrame:
    dens = X.ratio(F.col(population), F.col(area_ha))
    return df.withColumns({"population_density": dens, "log_population_density": X.safe_ln(dens),
                           "household_density": X.ratio(F.col(households), F.col(area_ha))})
