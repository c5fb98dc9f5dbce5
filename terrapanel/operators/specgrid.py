"""Specification grids: many sets of interactions under several fixed-effect structures, from one Gram matrix a structure.

A structure's rows are transformed once, with every column that any specification needs. Tasks add up outer products by cluster, clusters are merged by sums, and the whole is the
sum of the clusters. A specification is then a block of that matrix, and one pass over the clusters' matrices gives the
covariance of all specifications together. Only k-by-k numbers reach the driver, however many rows and clusters there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.regression import Fit, absorbed, holm, independent, period_interactions, prepare
from terrapanel.session import materialise

#: Numbers that a task holds for its clusters before it hands them on.
HELD = 1 << 22

TERMS = "spec string, structure string, controls boolean, set string, n_moderators int, term string, coef double, se double, t double, p double, n_obs long, n_clusters long, r2_within double"
JOINT = "spec string, structure string, controls boolean, set string, n_moderators int, wald_chi2 double, q int, p_chi2 double, F double, p_F double"
MARGINAL = "spec string, structure string, controls boolean, set string, moderator string, z double, estimate double, se double, t double, p double"


def every_subset(names: list[str]) -> dict[str, list[str]]:
    """All non-empty subsets in order of size, named by their members."""
    return {"+".join(c): list(c) for k in range(1, len(names) + 1) for c in combinations(names, k)}


def _outer(columns: list[str], weight: str | None):
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out():
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(held, pa.string()), "n": pa.array([int(m[0]) for m in held.values()], pa.int64()),
                                              "sums": pa.array([m[1:] for m in held.values()], pa.list_(pa.float64()))})

        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]) if batch.num_rows else np.zeros((0, k))
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(float) if weight else np.ones(len(x))
            names, place = np.unique(np.array(batch.column("__cluster").to_pylist(), dtype=object).astype(str), return_inverse=True)
            order = np.argsort(place, kind="stable")
            for name, rows in zip(names, np.split(order, np.cumsum(np.bincount(place, minlength=len(names)))[:-1])):
                m = np.concatenate([[len(rows)], ((x[rows] * w[rows, None]).T @ x[rows]).ravel()])
                held[name] = held[name] + m if name in held else m
                if len(held) * k * k > HELD:
                    yield from out()
                    held = {}
        if held:
            yield from out()
    return run


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for count, sums in zip(batch.column("n"), batch.column("sums")):
            n, sums = n + count.as_py(), sums.values.to_numpy()
            total = sums.copy() if total is None else total + sums
    yield pa.RecordBatch.from_pydict({"cluster": pa.array([key[0].as_py()], pa.string()), "n": pa.array([n], pa.int64()), "sums": pa.array([total], pa.list_(pa.float64()))})


CLUSTERS = "cluster string, n long, sums array<double>"


def cluster_grams(data: DataFrame, columns: list[str], cluster: list[str], weight: str | None = None) -> DataFrame:
    """(cluster, n, sums): the Gram matrix of the columns in each cluster, row by row; written once."""
    named = data.select(F.to_json(F.struct(*cluster)).alias("__cluster"), *columns, *([weight] if weight and weight not in columns else []))
    return materialise(named.mapInArrow(_outer(columns, weight), CLUSTERS).groupBy("cluster").applyInArrow(_merge, CLUSTERS))


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g, n, total = 0, 0, None
    for batch in batches:
        g += batch.num_rows
        for count, sums in zip(batch.column("n"), batch.column("sums")):
            n, sums = n + count.as_py(), sums.values.to_numpy()
            total = sums.copy() if total is None else total + sums
    if total is not None:
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([str(g)], pa.string()), "n": pa.array([n], pa.int64()), "sums": pa.array([total], pa.list_(pa.float64()))})


def _scores(specs: list[tuple[list[int], np.ndarray]], k: int):
    """Sums of the outer products of the clusters' scores, all specifications one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meats = [np.zeros((len(idx), len(idx))) for idx, _ in specs]
        for batch in batches:
            for sums in batch.column("sums"):
                g = sums.values.to_numpy().reshape(k, k)
                for meat, (idx, beta) in zip(meats, specs):
                    s = g[idx, k - 1] - g[np.ix_(idx, idx)] @ beta
                    meat += np.outer(s, s)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.concatenate([m.ravel() for m in meats])], pa.list_(pa.float64()))})
    return run


def _collected(df: DataFrame) -> np.ndarray:
    """The sum of a column of equally long arrays: one array a task reaches the driver."""
    rows = df.collect()
    return np.sum([np.array(r["sums"]) for r in rows], axis=0)


def fit_blocks(data: DataFrame, y: str, specs: dict[str, list[str]], fes: list[list[str]], cluster: list[str], weight: str | None = None) -> dict[str, Fit]:
    """A fit for every list of regressors over within-transformed ``data``; spanned regressors are dropped as in a single fit."""
    pool = list(dict.fromkeys(x for xs in specs.values() for x in xs))
    k, names = len(pool) + 1, [*pool, y]
    clusters = cluster_grams(data, names, cluster, weight)
    parts = clusters.mapInArrow(_total, CLUSTERS).collect()
    if not parts:
        nan = float("nan")
        return {s: Fit(y, list(xs), np.full(len(xs), nan), np.full((len(xs),) * 2, nan), 0, 0, nan, nan, nan, 0, data) for s, xs in specs.items()}
    n, size = sum(r["n"] for r in parts), sum(int(r["cluster"]) for r in parts)
    g = np.sum([np.array(r["sums"]) for r in parts], axis=0).reshape(k, k)
    levels = [(data.select(*fe).distinct(), fe) for fe in fes]
    nested = [(lv.count(), data.groupBy(*fe).agg((F.min(F.struct(*cluster)) == F.max(F.struct(*cluster))).alias("in")).where(~F.col("in")).isEmpty()) for lv, fe in levels]
    fe_params = absorbed(data, fes, nested)
    solved = {}
    for spec, xs in specs.items():
        every = [pool.index(x) for x in xs]
        idx = [every[i] for i in independent(g[np.ix_(every, every)])]
        if not idx:
            raise np.linalg.LinAlgError(f"no regressor of {spec!r} varies within the fixed effects")
        bread = np.linalg.inv(g[np.ix_(idx, idx)])
        solved[spec] = (idx, bread @ g[idx, k - 1], bread)
    flat = _collected(clusters.mapInArrow(_scores([(idx, beta) for idx, beta, _ in solved.values()], k), "sums array<double>"))
    out, at, tss = {}, 0, float(g[-1, -1])
    for spec, (idx, beta, bread) in solved.items():
        q = len(idx)
        meat, at = flat[at:at + q * q].reshape(q, q), at + q * q
        params, rss = q + fe_params, tss - float(beta @ g[idx, k - 1])
        vcov = bread @ meat @ bread * (size / (size - 1.0)) * (n - 1.0) / (n - params)
        kept = [pool[i] for i in idx]
        out[spec] = Fit(y, kept, beta, vcov, n, size, float(size - 1), rss, 1.0 - rss / tss, params, data, [x for x in specs[spec] if x not in kept])
    return out


def specification_grid(df: DataFrame, y: str, x: str, moderators: list[str], sets: dict[str, list[str]], structures: dict[str, list[list[str]]], cluster: list[str],
                       period: str, periods: list[int], reference: int, at: tuple[float, ...] = (-1.0, 0.0, 1.0), weight: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every set of moderators under every structure, without and with moderator-by-period controls.

    A specification regresses ``y`` on ``x`` and on x times each moderator of the set. Returned are the coefficients of those terms, with Holm's adjustment of the
    interactions' p-values inside each family (structure, controls, size of the set); the joint Wald test of the interactions; and for sets of one moderator
    the marginal effect of ``x`` at the values ``at``. Rows with a missing column take no part in any specification; a sample without
    rows gives missing numbers.
    """
    names = {m: f"{x}_{m}" for m in moderators}
    wide = df.withColumns({names[m]: F.col(x) * F.col(m) for m in moderators})
    controls: dict[str, list[str]] = {}
    for m in moderators:
        wide, controls[m] = period_interactions(wide, m, period, periods, reference)
    pool = [x, *names.values(), *[c for m in moderators for c in controls[m]]]
    terms, joint, marginal = [], [], []
    for structure, fes in structures.items():
        data = prepare(wide, [y, *pool], fes, cluster, weight)
        wanted = {(c, s): [x, *[names[m] for m in mods], *([z for m in mods for z in controls[m]] if c else [])] for c in (False, True) for s, mods in sets.items()}
        fits = fit_blocks(data, y, {f"{structure}|{c}|{s}": xs for (c, s), xs in wanted.items()}, fes, cluster, weight)
        for (c, s) in wanted:
            f, mods = fits[f"{structure}|{c}|{s}"], sets[s]
            head = (f"{structure}_{'periods' if c else 'plain'}_{s}", structure, c, s)
            mine = [names[m] for m in mods if names[m] in f.terms]
            for r in f.rows():
                if r[1] == x or r[1] in mine:
                    terms.append((*head, len(mods), r[1], *r[2:6], r[8], r[9], r[10]))
            w = f.wald(mine) if mine and f.n_obs else {}
            joint.append((*head, len(mods), w.get("wald_chi2"), len(mine), w.get("p_chi2"), w.get("F"), w.get("p_F")))
            if len(mods) == 1 and mine and f.n_obs:
                marginal += [(*head, mods[0], m["z"], m["estimate"], m["se"], m["t"], m["p"]) for m in f.marginal_effects(x, mine[0], list(at))]
    spark = df.sparkSession
    table = spark.createDataFrame(terms, TERMS)
    family = F.when(F.col("term") != x, F.concat_ws("|", "structure", F.col("controls").cast("string"), F.col("n_moderators").cast("string")))
    tested = holm(table.where(F.col("term") != x).withColumn("__family", family), "__family", "p", ["spec", "term"]).select("spec", "term", "p_holm")
    return table.join(tested, ["spec", "term"], "left"), spark.createDataFrame(joint, JOINT), spark.createDataFrame(marginal, MARGINAL)
