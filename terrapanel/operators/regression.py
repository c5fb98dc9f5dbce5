"""Fixed-effects regression as a few aggregations.

Rows are reduced to the Gram matrix of the within-transformed columns and to per-cluster moments;
only k-by-k numbers reach the driver. Cluster scores follow from the cluster's own moments, so one
table of cluster moments serves every specification over the same regressors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.functions import distributions as dist
from terrapanel.functions.expressions import mixed
from terrapanel.operators.joins import all_of, attach, with_replications, with_scalars
from terrapanel.operators.ranks import with_row_numbers
from terrapanel.operators.within import connected, within_transform
from terrapanel.session import materialise

FIT_SCHEMA = ("spec string, term string, coef double, se double, t double, p double, ci_low double, ci_high double, "
              "n_obs long, n_clusters long, r2_within double, pct_change_per_unit double")


@dataclass
class Fit:
    y: str
    terms: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n_obs: int
    n_clusters: int | None
    df_t: float
    rss: float
    r2_within: float
    n_params: int
    data: DataFrame = field(repr=False)
    #: Regressors left out because the ones before them span them.
    dropped: list[str] = field(default_factory=list)

    def index(self, terms: list[str]) -> list[int]:
        return [self.terms.index(t) for t in terms]

    def rows(self, spec: str = "") -> list[tuple]:
        if not self.n_obs:
            return [(spec, term, *[None] * 6, 0, 0 if self.n_clusters is not None else None, None, None) for term in self.terms]
        out, q = [], dist.t_quantile(0.975, self.df_t)
        for i, term in enumerate(self.terms):
            b, se = float(self.beta[i]), float(np.sqrt(self.vcov[i, i]))
            out.append((spec, term, b, se, b / se, dist.t_two_sided(b / se, self.df_t), b - q * se, b + q * se, self.n_obs,
                        self.n_clusters, self.r2_within, 100.0 * (float(np.exp(b)) - 1.0)))
        return out

    def table(self, spec: str = "") -> DataFrame:
        return self.data.sparkSession.createDataFrame(self.rows(spec), FIT_SCHEMA)

    def residuals(self, out: str = "u") -> DataFrame:
        """The within-transformed rows with a residual column; no second pass over the source."""
        fitted = sum((F.col(t) * F.lit(float(b)) for t, b in zip(self.terms[1:], self.beta[1:])), F.col(self.terms[0]) * F.lit(float(self.beta[0])))
        return self.data.withColumn(out, F.col(self.y) - fitted)

    def wald(self, terms: list[str]) -> dict:
        i = self.index(terms)
        b, v = self.beta[i], self.vcov[np.ix_(i, i)]
        w, q = float(b @ np.linalg.solve(v, b)), len(i)
        return {"wald_chi2": w, "q": q, "p_chi2": dist.chi2_upper(w, q), "F": w / q, "p_F": dist.f_upper(w / q, q, self.df_t)}

    def lincom(self, weights: dict[str, float]) -> dict:
        a = np.zeros(len(self.terms))
        for term, w in weights.items():
            a[self.terms.index(term)] = w
        est, se = float(a @ self.beta), float(np.sqrt(a @ self.vcov @ a))
        return {"estimate": est, "se": se, "t": est / se, "p": dist.t_two_sided(est / se, self.df_t)}

    def marginal_effects(self, x: str, interaction: str, at: list[float]) -> list[dict]:
        return [{"z": z, **self.lincom({x: 1.0, interaction: z})} for z in at]


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _symmetric(row, k: int, tag: str) -> np.ndarray:
    m = np.zeros((k, k))
    for i, j in _pairs(k):
        m[i, j] = m[j, i] = row[f"{tag}{i}_{j}"] or 0.0
    return m


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[int, np.ndarray]:
    """Row count and sum(w * c_i * c_j), from one aggregate."""
    w = _weight(weight)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in _pairs(len(columns))]).first()
    return row["n"], _symmetric(row, len(columns), "g")


def _score(i: int, beta: np.ndarray, subset: list[int], y: int) -> Column:
    """A cluster's score of column i, from its own moments."""
    def g(a: int, b: int) -> Column:
        return F.col(f"g{min(a, b)}_{max(a, b)}")
    return g(i, y) - sum((g(i, j) * F.lit(float(b)) for j, b in zip(subset, beta)), F.lit(0.0))


def cluster_meats(moments: DataFrame, specs: list[tuple[list[int], np.ndarray]], y: int) -> tuple[int, list[np.ndarray]]:
    """Number of clusters and the sum of score outer products for every (subset, beta), in one aggregate; ``y`` is the outcome's column."""
    aggs = [F.count(F.lit(1)).alias("g")]
    for s, (subset, beta) in enumerate(specs):
        scores = [_score(i, beta, subset, y) for i in subset]
        aggs += [F.sum(scores[a] * scores[b]).alias(f"m{s}_{a}_{b}") for a, b in _pairs(len(subset))]
    row = moments.agg(*aggs).first()
    return row["g"], [_symmetric(row, len(subset), f"m{s}_") for s, (subset, _) in enumerate(specs)]


@dataclass
class Moments:
    """Sums of products of a fit's columns, in total and for every level of its fixed effects and clusters, from one pass over the rows."""

    table: DataFrame = field(repr=False)
    keys: list[str]
    n: int
    gram: np.ndarray
    #: Levels of each fixed effect, and the clusterings of which each level lies inside one cluster.
    levels: list[tuple[int, set[tuple[str, ...]]]]

    def at(self, by: list[str]) -> DataFrame:
        return self.table.where(F.col("__set") == _set_id(self.keys, by))


def _set_id(keys: list[str], by: list[str]) -> int:
    return sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in by)


def summarise(data: DataFrame, columns: list[str], fes: list[list[str]], clusters: list[list[str]], weight: str | None = None) -> Moments:
    """:class:`Moments` of the within-transformed ``data``; partial aggregation keeps a dominant level cheap."""
    keys = list(dict.fromkeys(c for by in [*fes, *clusters] for c in by))
    sets = [()] + list(dict.fromkeys(tuple(c for c in keys if c in by) for by in [*fes, *clusters]))
    w, k = _weight(weight), len(columns)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in _pairs(k)]]
    inside = [F.struct(*c) for c in clusters]
    sums += [x for i, c in enumerate(inside) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]
    grouped = data.groupingSets(sets, *keys).agg(F.grouping_id().alias("__set"), *sums) if keys else data.agg(F.lit(0).alias("__set"), *sums)
    table = materialise(grouped)
    whole = F.col("__set") == _set_id(keys, [])
    parts = [a for i, by in enumerate(fes) for a in (F.count_if(F.col("__set") == _set_id(keys, by)).alias(f"levels{i}"), *[
        F.coalesce(F.bool_and(F.when(F.col("__set") == _set_id(keys, by), F.col(f"lo{j}") == F.col(f"hi{j}"))), F.lit(False)).alias(f"nested{i}_{j}") for j in range(len(inside))])]
    row = table.agg(F.max(F.when(whole, F.col("n"))).alias("n"), *[F.max(F.when(whole, F.col(f"g{i}_{j}"))).alias(f"g{i}_{j}") for i, j in _pairs(k)], *parts).first()
    levels = [(row[f"levels{i}"], {tuple(c) for j, c in enumerate(clusters) if row[f"nested{i}_{j}"]}) for i in range(len(fes))]
    return Moments(table, keys, row["n"] or 0, _symmetric(row, k, "g"), levels)


def absorbed(data: DataFrame, fes: list[list[str]], levels: list[tuple[int, bool]]) -> int:
    """Parameters charged to the fixed effects.

    Effects nested in a cluster count once in total, others fully less one each. Without nested ones two effects count as the rank of their
    dummies: levels less connected parts of the graph that the rows draw between them.
    """
    if not fes:
        return 1
    free = [(fe, n) for fe, (n, nested) in zip(fes, levels) if not nested]
    if len(free) < len(fes):
        return 1 + sum(n - 1 for _, n in free)
    if len(free) == 2:
        return free[0][1] + free[1][1] - connected(data, free[0][0], free[1][0])
    return sum(n for _, n in free) - (len(free) - 1)


def prepare(df: DataFrame, columns: list[str], fes: list[list[str]], keep: list[str], weight: str | None = None) -> DataFrame:
    """Complete cases, projected to what the fit needs, within-transformed."""
    names = list(dict.fromkeys([*columns, *[c for fe in fes for c in fe], *keep, *([weight] if weight else [])]))
    plain = [c for c in names if c not in columns]
    base = df.select(*plain, *[F.col(c).cast("double").alias(c) for c in columns])
    kinds = dict(base.dtypes)
    # one condition a column: a single one over many columns is copied by the optimizer for every way to rename them
    base = base.where(all_of([F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)) for c in names]))
    return within_transform(base, columns, fes or [[]], weight)


def independent(g: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Columns of a Gram matrix that earlier ones do not span, in order; the others would have no coefficient of their own."""
    kept: list[int] = []
    for j in range(len(g)):
        spanned = g[j, kept] @ np.linalg.solve(g[np.ix_(kept, kept)], g[kept, j]) if kept else 0.0
        if g[j, j] > 0 and g[j, j] - spanned > tolerance * g[j, j]:
            kept.append(j)
    return kept


def fit(df: DataFrame, y: str, xs: list[str], fes: list[list[str]] | None = None, cluster: list[list[str]] | str = "iid",
        weight: str | None = None, keep: list[str] | None = None, prepared: DataFrame | None = None) -> Fit:
    """OLS or WLS with absorbed fixed effects.

    ``fes`` lists fixed effects, each a list of key columns; none means an intercept. ``cluster`` is
    'iid', 'hc1', or one or two clusterings (each a list of key columns). ``keep`` names columns that
    residual analyses need later. Small-sample factors: G/(G-1) * (N-1)/(N-K) with K as in
    :func:`absorbed`, the smaller G for two-way clustering, and t(G-1) inference. A regressor that earlier ones span has no
    coefficient; it is named in ``dropped``.
    """
    fes = fes or []
    clusters = cluster if isinstance(cluster, list) else []
    if not isinstance(cluster, list) and cluster not in ("iid", "hc1"):
        raise ValueError(f"unknown covariance {cluster!r}")
    if len(clusters) > 2:
        raise ValueError("at most two clusterings")
    data = prepared if prepared is not None else prepare(df, [y, *xs], fes, [*[c for cl in clusters for c in cl], *(keep or [])], weight)
    return solve(data, y, xs, fes, cluster, weight, summarise(data, [*xs, y], fes, _sides(clusters), weight))


def _sides(clusters: list[list[str]]) -> list[list[str]]:
    """One or two clusterings, and for two the clusters of both."""
    return [*clusters, list(dict.fromkeys([*clusters[0], *clusters[1]]))] if len(clusters) == 2 else clusters


def ladder(df: DataFrame, y: str, xs: list[str], structures: dict[str, list[list[str]]], clusterings: dict[str, list[str]], weight: str | None = None) -> DataFrame:
    """Every fixed-effect structure under every clustering, as rows named structure_clustering; a structure's rows are transformed and summed once."""
    rows = []
    for spec, fes in structures.items():
        data = prepare(df, [y, *xs], fes, [c for by in clusterings.values() for c in by], weight)
        found = summarise(data, [*xs, y], fes, list(clusterings.values()), weight)
        for name, by in clusterings.items():
            rows += solve(data, y, xs, fes, [by], weight, found).rows(f"{spec}_{name}")
    return df.sparkSession.createDataFrame(rows, FIT_SCHEMA)


def solve(data: DataFrame, y: str, xs: list[str], fes: list[list[str]], cluster: list[list[str]] | str, weight: str | None, found: Moments) -> Fit:
    """A fit of within-transformed ``data`` from its moments."""
    clusters = cluster if isinstance(cluster, list) else []
    sides = _sides(clusters)
    n, g = found.n, found.gram
    if not n:
        return _no_fit(y, xs, clusters, data)
    kept = independent(g[:-1, :-1])
    if xs and not kept:
        raise np.linalg.LinAlgError(f"no regressor varies within the fixed effects: {xs}")
    dropped, last = [x for i, x in enumerate(xs) if i not in kept], len(xs)
    xs, g = [xs[i] for i in kept], g[np.ix_([*kept, -1], [*kept, -1])]
    k = len(xs)
    bread = np.linalg.inv(g[:k, :k])
    beta = bread @ g[:k, k]
    rss = float(g[k, k] - beta @ g[:k, k])
    params = k + absorbed(data, fes, [(count, any(tuple(c) in nested for c in clusters)) for count, nested in found.levels])
    n_clusters = None
    if not clusters:
        df_t = float(n - params)
        if cluster == "iid":
            vcov = bread * rss / (n - params)
        else:
            w = _weight(weight)
            u = F.col(y) - sum((F.col(x) * F.lit(float(b)) for x, b in zip(xs, beta)), F.lit(0.0))
            scored = data.select(*[(w * F.col(x) * u).alias(f"q{i}") for i, x in enumerate(xs)])
            _, meat = gram(scored, [f"q{i}" for i in range(k)])
            vcov = bread @ meat @ bread * n / (n - params)
    else:
        total, sizes = np.zeros((k, k)), []
        for i, c in enumerate(sides):
            size, meats = cluster_meats(found.at(c), [(kept, beta)], last)
            total += -meats[0] if i == 2 else meats[0]
            sizes.append(size)
        n_clusters = min(sizes[:len(clusters)])
        df_t = float(n_clusters - 1)
        vcov = bread @ total @ bread * (n_clusters / (n_clusters - 1.0)) * (n - 1.0) / (n - params)
    tss = float(g[k, k])
    return Fit(y, list(xs), beta, vcov, n, n_clusters, df_t, rss, 1.0 - rss / tss if tss > 0 else float("nan"), params, data, dropped)


def _no_fit(y: str, xs: list[str], clusters: list, data: DataFrame) -> Fit:
    """The answer for a sample without rows: no observations, and every number missing."""
    k, nan = len(xs), float("nan")
    return Fit(y, list(xs), np.full(k, nan), np.full((k, k), nan), 0, 0 if clusters else None, nan, nan, nan, 0, data)


def sweep(df: DataFrame, y: str, subsets: dict[str, list[str]], fes: list[list[str]], cluster: list[str], weight: str | None = None) -> DataFrame:
    """Every specification over subsets of one regressor pool from one Gram matrix and one cluster table."""
    pool = list(dict.fromkeys(x for xs in subsets.values() for x in xs))
    data = prepare(df, [y, *pool], fes, cluster, weight)
    found = summarise(data, [*pool, y], fes, [cluster], weight)
    n, g, last = found.n, found.gram, len(pool)
    if not n:
        rows = [r for name, xs in subsets.items() for r in _no_fit(y, xs, [cluster], data).rows(name)]
        return df.sparkSession.createDataFrame(rows, FIT_SCHEMA)
    fe_params = absorbed(data, fes, [(count, tuple(cluster) in nested) for count, nested in found.levels])
    specs, breads, used = [], [], {}
    for name, xs in subsets.items():
        every = [pool.index(x) for x in xs]
        idx = [every[i] for i in independent(g[np.ix_(every, every)])]
        if not idx:
            raise np.linalg.LinAlgError(f"no regressor of {name!r} varies within the fixed effects")
        used[name] = [pool[i] for i in idx]
        bread = np.linalg.inv(g[np.ix_(idx, idx)])
        specs.append((idx, bread @ g[idx, last]))
        breads.append(bread)
    size, meats = cluster_meats(found.at(cluster), specs, last)
    rows = []
    for (name, xs), (idx, beta), bread, meat in zip(used.items(), specs, breads, meats):
        rss = float(g[last, last] - beta @ g[idx, last])
        params = len(idx) + fe_params
        vcov = bread @ meat @ bread * (size / (size - 1.0)) * (n - 1.0) / (n - params)
        rows += Fit(y, xs, beta, vcov, n, size, float(size - 1), rss, 1.0 - rss / float(g[last, last]), params, data).rows(name)
    return df.sparkSession.createDataFrame(rows, FIT_SCHEMA)


def nested_f(restricted: Fit, full: Fit, extra: int, full_params: int) -> dict:
    df2 = full.n_obs - full_params
    f = ((restricted.rss - full.rss) / extra) / (full.rss / df2)
    return {"F": f, "df1": extra, "df2": df2, "p": dist.f_upper(f, extra, df2)}


def holm(table: DataFrame, family: str, p: str, key: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjustment within families of tests; ties broken by ``key``."""
    part = Window.partitionBy(family)
    order = part.orderBy(F.col(p).asc_nulls_last(), *key)
    step = (F.count(p).over(part) - F.row_number().over(order) + 1) * F.col(p)
    return (table.withColumn("__s", step)
            .withColumn(out, F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s"))


def period_interactions(df: DataFrame, column: str, period: str, periods: list[int], reference: int) -> tuple[DataFrame, list[str]]:
    """Columns column x (period = p) for every p but the reference."""
    names = {p: f"{column}_x_{p}" for p in periods if p != reference}
    return df.withColumns({n: F.when(F.col(period) == p, F.col(column)).otherwise(F.when(F.col(column).isNotNull(), F.lit(0.0))) for p, n in names.items()}), list(names.values())


def first_difference_serial_test(df: DataFrame, y: str, x: str, entity: str, period: str) -> dict:
    """Residuals of the differenced model on their own lag, clustered by entity; H0 rho = -0.5."""
    w = Window.partitionBy(entity).orderBy(period)
    fd = df.withColumns({"dy": F.col(y) - F.lag(y).over(w), "dx": F.col(x) - F.lag(x).over(w)})
    f = fit(fd, "dy", ["dx"], [[period]], [[entity]])
    u = f.residuals("u").withColumn("u_lag", F.lag("u").over(w)).where(F.col("u_lag").isNotNull())
    per = u.groupBy(entity).agg(F.sum(F.col("u") * F.col("u_lag")).alias("c"), F.sum(F.col("u_lag") * F.col("u_lag")).alias("d"), F.count(F.lit(1)).alias("k"))
    row = per.agg(F.sum("c").alias("c"), F.sum("d").alias("d"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("g"),
                  *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in (("c", "c"), ("c", "d"), ("d", "d"))]).first()
    rho = row["c"] / row["d"]
    meat = row["cc"] - 2 * rho * row["cd"] + rho * rho * row["dd"]
    g, n = row["g"], row["n"]
    se = float(np.sqrt(meat * g / (g - 1.0) * (n - 1.0) / (n - 1.0))) / row["d"]
    t = (rho + 0.5) / se
    return {"rho_hat": float(rho), "se": se, "t": float(t), "p": dist.normal_two_sided(t), "n": n}


def breusch_pagan(residuals: DataFrame, u: str, columns: list[str]) -> dict:
    """LM and F tests of squared residuals on a constant and ``columns``."""
    d = residuals.withColumns({"__e2": F.col(u) * F.col(u), "__one": F.lit(1.0)})
    names = ["__one", *columns, "__e2"]
    n, g = gram(d, names)
    k = len(columns) + 1
    b = np.linalg.solve(g[:k, :k], g[:k, k])
    tss = g[k, k] - g[0, k] ** 2 / n
    r2 = 1.0 - float(g[k, k] - b @ g[:k, k]) / tss
    f = (r2 / (k - 1)) / ((1 - r2) / (n - k))
    return {"lm": float(n * r2), "lm_p": float(dist.chi2_upper(n * r2, k - 1)), "F": float(f), "F_p": float(dist.f_upper(f, k - 1, n - k))}


def partial_out(df: DataFrame, targets: list[str], control: str) -> DataFrame:
    """Remove one regressor from already demeaned columns: two sums per column, then an expression."""
    c = F.col(control)
    sums = df.agg(F.sum(c * c).alias("__cc"), *[F.sum(c * F.col(t)).alias(f"__c_{t}") for t in targets])
    return with_scalars(df, sums).withColumns({t: F.col(t) - c * F.col(f"__c_{t}") / F.col("__cc") for t in targets}).drop("__cc", *[f"__c_{t}" for t in targets])


def wild_cluster_bootstrap(data: DataFrame, y: str, x: str, cluster: str, period: str | None, reps: int = 999, seed: int = 123, corrected: bool = False) -> DataFrame:
    """Rademacher bootstrap-t with the null imposed, on within-transformed balanced rows.

    Everything is collapsed to cluster sums (and cluster-by-period sums when the second fixed effect
    is common to all clusters, ``period``); replications multiply those small tables, not the rows. That needs every cluster's rows to be
    spread over the periods alike; other panels raise a ValueError.
    """
    if period:
        k = data.groupBy(F.col(cluster).alias("g"), F.col(period).alias("p")).agg(F.count(F.lit(1)).alias("k"))
        uneven = k.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("periods"))
        row = uneven.agg(F.count_if(F.col("lo") != F.col("hi")).alias("holes"), F.count_distinct("periods").alias("spans")).first()
        if row["holes"] or row["spans"] > 1:
            raise ValueError("the collapsed bootstrap needs a balanced panel: every cluster observed alike in every period")
    xc, yc = F.col(x), F.col(y)
    base = data.groupBy(F.col(cluster).alias("g")).agg(F.sum(xc * yc).alias("c"), F.sum(xc * xc).alias("d"))
    total = base.agg(F.sum("c").alias("sxy"), F.sum("d").alias("sxx"), F.count(F.lit(1)).alias("n_clusters"))
    actual = with_scalars(base, total).withColumn("b", F.col("sxy") / F.col("sxx")).agg(
        F.max("b").alias("coef"), (F.max("b") * F.max("sxx") / F.sqrt(F.sum((F.col("c") - F.col("b") * F.col("d")) ** 2))).alias("t_raw"), F.max("n_clusters").alias("n_clusters"))
    # signs by the number of the cluster in the order of its key
    names = materialise(with_row_numbers(base.select("g"), [], [F.col("g").asc()], "number", "clusters").select("g", "number"))
    sign = F.when(mixed(F.col("number"), F.col("rep"), seed) % 2 == 0, 1.0).otherwise(-1.0)
    rep = with_replications(base.join(names, "g"), reps).withColumn("w", sign).drop("number")
    shift = None
    if period:
        cells = data.groupBy(F.col(cluster).alias("g"), F.col(period).alias("p")).agg(F.sum(yc).alias("a"), F.sum(xc).alias("x"), F.count(F.lit(1)).alias("k"))
        size = cells.groupBy("p").agg(F.sum("k").alias("n"))
        means = with_replications(cells.join(names, "g"), reps).withColumn("w", sign).groupBy("rep", "p").agg(F.sum(F.col("w") * F.col("a")).alias("m"))
        means = means.join(size, "p").select("rep", "p", (F.col("m") / F.col("n")).alias("m"))
        shift = means.join(cells, "p").groupBy("rep", "g").agg(F.sum(F.col("m") * F.col("x")).alias("shift"))
    betas = rep.groupBy("rep").agg((F.sum(F.col("w") * F.col("c")) / F.sum("d")).alias("b"), F.sum("d").alias("sxx"))
    rep = rep.join(betas, "rep")
    rep = attach(rep, shift, ["rep", "g"]) if shift is not None else rep.withColumn("shift", F.lit(0.0))
    score = F.col("w") * F.col("c") - F.col("shift") - F.col("b") * F.col("d")
    stats = rep.groupBy("rep").agg((F.max("b") * F.max("sxx") / F.sqrt(F.sum(score * score))).alias("t"))
    hits = with_scalars(stats, actual.select("t_raw")).agg(F.count_if(F.abs("t") >= F.abs("t_raw")).alias("h"))
    p = (F.col("h") + 1) / F.lit(reps + 1.0) if corrected else F.col("h") / F.lit(float(reps))
    return with_scalars(actual, hits).select("coef", "t_raw", "n_clusters", p.alias("p_wild"), F.lit(reps).cast("long").alias("reps"))


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Largest gap per column between two result tables and the rows they share."""
    right = b.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns])
    return a.join(right, keys).agg(F.count(F.lit(1)).alias("n_matched"), *[F.max(F.abs(F.col(c) - F.col(f"__b_{c}"))).alias(f"max_diff_{c}") for c in columns])
