"""Correlation, collinearity and factor operators built on one k-by-k aggregate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.joins import attach
from terrapanel.operators.quantiles import quantile_bins, with_average_ranks
from terrapanel.operators.within import demean


def cross_moments(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Pairwise correlations as rows (by, a, b, n, r); pairs with a NULL drop out pairwise.

    Every pair is a partial aggregate, so the shuffle carries k*k numbers per group and task.
    """
    by = by or []
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    both = {p: F.col(p[0]).isNotNull() & F.col(p[1]).isNotNull() for p in pairs}
    wide = df.groupBy(*by).agg(*[x for i, p in enumerate(pairs) for x in (
        F.corr(*p).alias(f"__r{i}"), F.count_if(both[p]).alias(f"__n{i}"))])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"__n{i}").alias("n"), F.col(f"__r{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return wide.select(*by, F.inline(rows))


def pearson_levels(df: DataFrame, columns: list[str], entity: str, period: str) -> DataFrame:
    """Pooled, between, within and two-way within correlations."""
    d = df.dropna(subset=columns)
    between = d.groupBy(entity).agg(*[F.avg(c).alias(c) for c in columns])
    within = demean(d, columns, [entity])
    both = demean(d, columns, [entity], [period])
    levels = [("pooled", d), ("between", between), ("within", within), ("two_way_within", both)]
    tables = [cross_moments(x, columns).withColumn("level", F.lit(name)) for name, x in levels]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def spearman(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rank correlations from average ranks over complete cases."""
    by = by or []
    ranked = with_average_ranks(df.dropna(subset=columns).select(*by, *columns), by, columns, "__rank_")
    return cross_moments(ranked.select(*by, *[F.col(f"__rank_{c}").alias(c) for c in columns]), columns, by)


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.abs("r").desc(), "a", "b")


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and the population covariance matrix; one row of k(k+3)/2 numbers reaches the driver."""
    d = df.dropna(subset=columns)
    k = len(columns)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    aggs += [F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    row = d.agg(*aggs).first()
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return row["n"], np.array([row[f"m{i}"] for i in range(k)]), cov


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    _, _, cov = moments(df, columns)
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd)


def partial_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    p = np.linalg.inv(correlation_matrix(df, columns))
    d = np.sqrt(np.diag(p))
    rows = [(columns[i], columns[j], float(-p[i, j] / (d[i] * d[j]))) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, partial_r double")


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation with a constant: the diagonal of the inverse correlation matrix."""
    d = np.diag(np.linalg.inv(correlation_matrix(df, columns)))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, d)], "regressor string, vif double")


def _fix_sign(v: np.ndarray) -> np.ndarray:
    """Each component's largest loading is positive."""
    lead = v[np.argmax(np.abs(v), axis=0), range(v.shape[1])]
    return v * np.where(lead < 0, -1.0, 1.0)


def pca(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(eigenvalues, loadings, eigenvectors) of population-standardised columns with the n/(n-1) factor."""
    n, _, _ = moments(df, columns)
    values, vectors = np.linalg.eigh(correlation_matrix(df, columns))
    order = np.argsort(values)[::-1]
    values, vectors = values[order] * n / (n - 1.0), _fix_sign(vectors[:, order])
    share = values / values.sum()
    spark = df.sparkSession
    eig = spark.createDataFrame([(i + 1, float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(values, share, share.cumsum()))],
                                "component long, eigenvalue double, share double, cumulative double")
    load = spark.createDataFrame([(c, j + 1, float(vectors[i, j])) for i, c in enumerate(columns) for j in range(len(columns))],
                                 "variable string, component long, loading double")
    return eig, load, vectors


def pca_scores(df: DataFrame, columns: list[str], vectors: np.ndarray, k: int) -> DataFrame:
    """Add pc1..pck: a linear expression in the standardised columns."""
    _, mean, cov = moments(df, columns)
    sd = np.sqrt(np.diag(cov))
    z = [(F.col(c) - F.lit(float(mean[i]))) / F.lit(float(sd[i])) for i, c in enumerate(columns)]
    return df.withColumns({f"pc{j + 1}": sum((z[i] * F.lit(float(vectors[i, j])) for i in range(1, len(z))), z[0] * F.lit(float(vectors[0, j])))
                           for j in range(k)})


def binned_scatter(df: DataFrame, x: str, y: str, k: int, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return quantile_bins(df.where(F.col(y).isNotNull()), by, x, k, "bin").groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))


def simple_regression(df: DataFrame, y: str | Column, x: str | Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
                                       F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def attach_group_means(df: DataFrame, columns: list[str], by: list[str], suffix: str = "_mean") -> DataFrame:
    return attach(df, df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in columns]), by)
