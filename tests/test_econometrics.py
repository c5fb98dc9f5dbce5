"""Regression and panel tests against dense algebra, published values and row-level algorithms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.functions import distributions as dist
from terrapanel.operators import correlation, paneltests as pt, proximity, regression as reg, within as wt
from terrapanel.session import materialise as session_materialise


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for lad in range(20):
        for m in range(6):
            a = rng.normal()
            for year in range(8):
                x = rng.normal() + 0.3 * lad % 3
                rows.append((f"L{lad}", f"L{lad}M{m}", year, a + 0.1 * year + 0.5 * x + rng.normal(), x, rng.normal(), float(rng.integers(5, 50))))
    pdf = pd.DataFrame(rows, columns=["lad", "area", "year", "y", "x", "z", "w"])
    return spark.createDataFrame(pdf).cache(), pdf


def dense(pdf, xs, fes, w=None):
    """Least squares with explicit dummies."""
    d = [pd.get_dummies(pdf[f].astype(str).agg("_".join, axis=1) if isinstance(f, list) else pdf[f].astype(str)).to_numpy(float) for f in fes]
    m = np.hstack([pdf[xs].to_numpy(float), *d]) if d else np.column_stack([pdf[xs], np.ones(len(pdf))])
    s = np.sqrt(pdf[w].to_numpy()) if w else np.ones(len(pdf))
    b, *_ = np.linalg.lstsq(m * s[:, None], pdf["y"].to_numpy() * s, rcond=None)
    return b[:len(xs)], pdf["y"].to_numpy() - m @ b


@pytest.mark.parametrize("fes", [[], [["year"]], [["area"], ["year"]], [["area"], ["lad", "year"]]])
def test_slopes_match_dummy_regression(panel, fes):
    df, pdf = panel
    f = reg.fit(df, "y", ["x", "z"], fes, [["lad"]])
    want, u = dense(pdf, ["x", "z"], fes)
    assert np.allclose(f.beta, want, atol=1e-8) and f.rss == pytest.approx(float(u @ u))


@pytest.mark.parametrize("weight", [None, "w"])
def test_unbalanced_and_weighted_panels_stay_exact(panel, weight):
    df, pdf = panel
    keep = (pdf.index * 7 + pdf.year) % 5 != 0
    hole = df.sparkSession.createDataFrame(pdf[keep])
    f = reg.fit(hole, "y", ["x", "z"], [["area"], ["year"]], [["lad"]], weight=weight)
    want, _ = dense(pdf[keep].reset_index(drop=True), ["x", "z"], [["area"], ["year"]], weight)
    assert np.allclose(f.beta, want, atol=1e-7)


def two_way_dense(pdf, columns, a, b, w=None):
    """Residuals after both sets of dummies, by the normal equations of the smaller set."""
    ia, ib = pd.factorize(pdf[a])[0], pd.factorize(pdf[b])[0]
    w = pdf[w].to_numpy() if w else np.ones(len(pdf))
    n = np.zeros((ia.max() + 1, ib.max() + 1))
    np.add.at(n, (ia, ib), w)
    na = n.sum(axis=1)
    left = np.diag(n.sum(axis=0)) - n.T @ (n / na[:, None])
    out = []
    for c in columns:
        v = pdf[c].to_numpy()
        mean = np.bincount(ia, w * v) / na
        effect = np.linalg.lstsq(left, np.bincount(ib, w * (v - mean[ia])), rcond=1e-12)[0]
        out.append(v - effect[ib] - ((np.bincount(ia, w * v) - n @ effect) / na)[ia])
    return np.array(out).T


@pytest.mark.parametrize("weight", [None, "w"])
def test_large_panel_with_holes_is_exact_in_few_steps(spark, monkeypatch, weight):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame([(i, t) for i in range(2000) for t in range(25) if rng.random() > 0.3 + 0.02 * (t % 9)], columns=["i", "t"])
    pdf["y"], pdf["x"] = rng.normal(100, 1, len(pdf)) + pdf["t"] * pdf["i"] % 7, rng.normal(size=len(pdf)) + pdf["t"]
    pdf["w"] = rng.gamma(1.0, 1.0, len(pdf)) + 0.01
    written = []
    monkeypatch.setattr(wt, "materialise", lambda df: (written.append(df.columns), session_materialise(df))[1])
    got = wt.within_transform(spark.createDataFrame(pdf), ["y", "x"], [["i"], ["t"]], weight).toPandas().sort_values(["i", "t"])
    assert np.abs(got[["y", "x"]].to_numpy() - two_way_dense(pdf, ["y", "x"], "i", "t", weight)).max() < 1e-9
    steps = sum("q0" in c for c in written)
    assert steps < 30


def test_two_large_effects_and_three_effects(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"i": rng.integers(0, 400, 4000), "j": rng.integers(0, 300, 4000), "k": rng.integers(0, 5, 4000), "x": rng.normal(size=4000)})
    pdf["y"] = pdf["x"] * 0.5 + pdf["i"] % 13 + pdf["j"] % 7 + rng.normal(size=4000)
    df = spark.createDataFrame(pdf)
    want = two_way_dense(pdf, ["y", "x"], "i", "j")
    f = reg.fit(df, "y", ["x"], [["i"], ["j"]], "iid")
    assert f.beta[0] == pytest.approx((want[:, 1] @ want[:, 0]) / (want[:, 1] @ want[:, 1]), rel=1e-10)
    three = reg.fit(df, "y", ["x"], [["i"], ["j"], ["k"]], [["i"]])
    assert three.beta[0] == pytest.approx(dense(pdf, ["x"], ["i", "j", "k"])[0][0], rel=1e-8)


def test_disconnected_effects_count_their_rank(spark):
    """Two blocks of entities that share no period: the dummies have one rank less than a connected panel's."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame([(i, t + 5 * (i // 6), float(rng.normal()), float(rng.normal())) for i in range(12) for t in range(5)], columns=["i", "t", "x", "y"])
    d = np.hstack([pdf[["x"]].to_numpy(), pd.get_dummies(pdf["i"]).to_numpy(float), pd.get_dummies(pdf["t"]).to_numpy(float)])
    b, _, rank, _ = np.linalg.lstsq(d, pdf["y"].to_numpy(), rcond=None)
    u = pdf["y"].to_numpy() - d @ b
    x = two_way_dense(pdf, ["x"], "i", "t")[:, 0]
    f = reg.fit(spark.createDataFrame(pdf), "y", ["x"], [["i"], ["t"]], "iid")
    assert f.n_params == rank == 1 + 20 and f.vcov[0, 0] == pytest.approx(u @ u / (len(pdf) - rank) / (x @ x))
    h = reg.fit(spark.createDataFrame(pdf), "y", ["x"], [["i"], ["t"]], "hc1")
    assert h.vcov[0, 0] == pytest.approx(((x * u) ** 2).sum() / (x @ x) ** 2 * len(pdf) / (len(pdf) - rank))


def test_nested_effects_leave_the_finer_one(panel):
    df, pdf = panel
    f = reg.fit(df, "y", ["x"], [["area"], ["lad"]], [["lad"]])
    assert f.beta[0] == pytest.approx(dense(pdf, ["x"], ["area"])[0][0], rel=1e-10)


def test_sample_without_rows(panel):
    df, _ = panel
    for cluster in ("iid", "hc1", [["lad"]]):
        f = reg.fit(df.where("year < 0"), "y", ["x", "z"], [["area"], ["year"]], cluster)
        row = f.table("empty").collect()
        assert [r.term for r in row] == ["x", "z"] and all(r.coef is None and r.se is None and r.n_obs == 0 for r in row)
    assert [r.coef for r in reg.sweep(df.where("year < 0"), "y", {"a": ["x"]}, [["area"]], ["lad"]).collect()] == [None]


def test_covariances_match_row_level(panel):
    df, pdf = panel
    fes = [["area"], ["year"]]
    f = {k: reg.fit(df, "y", ["x", "z"], fes, c) for k, c in (("iid", "iid"), ("hc1", "hc1"), ("lad", [["lad"]]), ("two", [["lad"], ["year"]]))}
    x = pdf[["x", "z"]] - pdf.groupby("area")[["x", "z"]].transform("mean")
    x = (x - x.groupby(pdf["year"]).transform("mean")).to_numpy()
    _, u = dense(pdf, ["x", "z"], fes)
    n, bread = len(pdf), np.linalg.inv(x.T @ x)
    k_all = 2 + 120 + 8 - 1
    assert np.allclose(f["iid"].vcov, bread * (u @ u) / (n - k_all))
    s = x * u[:, None]
    assert np.allclose(f["hc1"].vcov, bread @ (s.T @ s) @ bread * n / (n - k_all))

    def meat(key):
        g = pd.DataFrame(s).groupby(key).sum().to_numpy()
        return g.T @ g, len(g)

    a, ga = meat(pdf["lad"])
    assert np.allclose(f["lad"].vcov, bread @ a @ bread * ga / (ga - 1) * (n - 1) / (n - (2 + 1 + 7)))
    b, gb = meat(pdf["year"])
    c, _ = meat(pdf["lad"] + pdf["year"].astype(str))
    g = min(ga, gb)
    assert np.allclose(f["two"].vcov, bread @ (a + b - c) @ bread * g / (g - 1) * (n - 1) / (n - 3))
    assert f["two"].n_clusters == 8


def test_sweep_equals_single_fits(panel):
    df, _ = panel
    fes = [["area"], ["year"]]
    out = {(r.spec, r.term): r for r in reg.sweep(df, "y", {"a": ["x"], "b": ["x", "z"]}, fes, ["lad"]).collect()}
    one = reg.fit(df, "y", ["x", "z"], fes, [["lad"]]).rows()
    assert out[("b", "z")].coef == pytest.approx(one[1][2]) and out[("b", "z")].se == pytest.approx(one[1][3])


def test_wald_lincom_and_failures(panel):
    df, _ = panel
    f = reg.fit(df, "y", ["x", "z"], [["area"]], [["lad"]])
    w = f.wald(["x"])
    row = f.rows()[0]
    assert w["wald_chi2"] == pytest.approx(row[4] ** 2) and w["p_F"] == pytest.approx(row[5], abs=1e-10)
    assert f.lincom({"x": 1.0, "z": 0.0})["se"] == pytest.approx(row[3])
    assert [m["z"] for m in f.marginal_effects("x", "z", [-1, 0, 1])] == [-1, 0, 1]
    with pytest.raises(ValueError):
        reg.fit(df, "y", ["x"], cluster="robust")


@pytest.mark.parametrize("period", ["year", None])
def test_collapsed_bootstrap_equals_row_level(panel, period):
    df, pdf = panel
    second = ["year"] if period else ["lad", "year"]
    data = reg.prepare(df, ["y", "x"], [["area"], second], ["lad", "year"])
    reps = 60
    got = reg.wild_cluster_bootstrap(data, "y", "x", "lad", period, reps, 5).first()
    signs = pd.DataFrame([(lad, r, 1.0 if pt.mixed(i + 1, r, 5) % 2 == 0 else -1.0) for i, lad in enumerate(sorted(pdf["lad"].unique())) for r in range(reps)], columns=["lad", "rep", "w"])
    d = data.toPandas()

    def stat(y):
        b = (d.x * y).sum() / (d.x ** 2).sum()
        s = (d.x * (y - b * d.x)).groupby(d.lad).sum()
        return b / (math.sqrt((s ** 2).sum()) / (d.x ** 2).sum())

    t0, hits = stat(d.y), 0
    for r in range(reps):
        w = d.lad.map(signs[signs.rep == r].set_index("lad").w)
        ys = w * d.y
        ys = ys - ys.groupby(d.area).transform("mean")
        ys = ys - ys.groupby([d[c] for c in second]).transform("mean")
        hits += abs(stat(ys)) >= abs(t0)
    assert got.t_raw == pytest.approx(t0) and got.p_wild == pytest.approx(hits / reps)


def test_holm(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.20])], "fam string, i int, p double")
    got = [r.p_holm for r in reg.holm(df, "fam", "p", ["i"]).orderBy("i").collect()]
    assert got == pytest.approx([0.04, 0.09, 0.09, 0.20])


def test_distributions():
    assert dist.t_two_sided(1.3174, 293) == pytest.approx(0.188732, abs=3e-5)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert dist.f_upper(4.0, 1, 10) == pytest.approx(dist.t_two_sided(2.0, 10))
    assert dist.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.chi2_upper(20.0, 3) == pytest.approx(0.00016974243555282632)
    assert dist.normal_cdf(1.959963984540054) == pytest.approx(0.975)


def test_hadri_moments():
    m8, v8 = pt.hadri_moments(8)
    assert (m8, v8) == pytest.approx((0.1875, 0.015625))
    assert pt.hadri_moments(12) == pytest.approx((0.180556, 0.017747), abs=1e-6)


def test_unit_root_tests_tell_walks_from_noise(spark):
    rng = np.random.default_rng(1)
    n, t = 300, 10
    noise = rng.normal(size=(n, t))
    for name, y, unit_root in (("noise", noise, False), ("walk", noise.cumsum(axis=1), True)):
        df = spark.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(n), t), "t": np.tile(np.arange(t), n), "y": y.ravel()}))
        assert (pt.harris_tzavalis(df, "i", "t", "y").first().p > 0.01) == unit_root
        assert (pt.hadri(df, "i", "t", "y").first().p < 0.01) == unit_root


def test_cd_identity(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(40, 9)) + rng.normal(size=9)
    df = spark.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(40), 9), "t": np.tile(np.arange(9), 40), "y": e.ravel()}))
    c = np.corrcoef(e)
    want = math.sqrt(2 * 9 / (40 * 39)) * c[np.triu_indices(40, 1)].sum()
    assert pt.pesaran_cd(df, "i", "t", "y").first().cd == pytest.approx(want)


def test_permutation_tests_match_brute_force(spark, monkeypatch):
    """Two groups, one entity without links, one that has a value in one group only; several blocks of replications and parts of links."""
    rng = np.random.default_rng(4)
    n, reps = 25, 250
    monkeypatch.setattr(pt, "PART", 7)
    links = [(i, j) for i in range(n - 1) for j in (i - 1, i + 1, i + 5) if 0 <= j < n - 1]
    rows = [(i, g, float(rng.normal())) for g in ("a", "b") for i in range(n) if (i, g) != (3, "b")]
    v, e = spark.createDataFrame(rows, "id int, g string, v double"), spark.createDataFrame(links, "src int, dst int")
    glob = {r.g: r for r in pt.moran_permutation(v, e, "id", "v", ["g"], reps, 9).collect()}
    local = {(r.g, r.id): r.p_sim for r in pt.local_moran_permutation(v, e, "id", "v", ["g"], reps, 9).collect()}
    for g in ("a", "b"):
        ids = [i for i, h, _ in rows if h == g]
        d = np.array([x for _, h, x in rows if h == g])
        d = d - d.mean()
        near = [[ids.index(j) for a, j in links if a == i and j in ids] for i in ids]

        def moran(z):
            lag = [(z[k], np.mean([z[j] for j in nb])) for k, nb in enumerate(near) if nb]
            return len(z) / len(lag) * sum(a * b for a, b in lag) / (z @ z)

        sims, larger, actual = [], np.zeros(len(ids)), moran(d)
        for rep in range(1, reps + 1):
            order = sorted(range(len(ids)), key=lambda k: (pt.mixed(k + 1, rep, 9), k))
            sims.append(moran(d[order]))
            for k, nb in enumerate(near):
                if nb:
                    draw = [m for m in order if m != k][:len(nb)]
                    larger[k] += d[k] * d[draw].mean() >= d[k] * d[nb].mean() - 1e-9 * abs(d[k] * d[nb].mean())
        hits = sum(s >= actual - 1e-9 * abs(actual) for s in sims)
        assert glob[g].morans_i == pytest.approx(actual) and glob[g].p_sim == pytest.approx((min(hits, reps - hits) + 1) / (reps + 1))
        assert glob[g].z_sim == pytest.approx((actual - np.mean(sims)) / np.std(sims))
        for k, i in enumerate(ids):
            assert local[g, i] == (pytest.approx((min(larger[k], reps - larger[k]) + 1) / (reps + 1)) if near[k] else None)


def test_first_of_an_order_with_ties(monkeypatch):
    for keys in (pt.mixed, lambda number, rep, seed: number * 7 % 5):
        monkeypatch.setattr(pt, "mixed", keys)
        for k in (1, 2, 9, 29, 30, 31):
            assert pt._first(30, 3, 7, k).tolist() == pt._order(30, 3, 7)[:k].tolist()


@pytest.mark.parametrize("task", ["_conditional_counts", "_permuted_near", "_permuted_sums"])
def test_blocks_of_replications_are_not_put_together(spark, monkeypatch, tmp_path, task):
    """Blocks of few bytes run in several tasks: each leaves the number of its partition."""
    make, seen = getattr(pt, task), str(tmp_path)

    def told(*args):
        run = make(*args)

        def mark():
            from pyspark import TaskContext
            open(f"{seen}/{TaskContext.get().partitionId()}", "w").close()

        def one(key, rows):
            mark()
            return run(key, rows)

        def two(key, rows, links):
            mark()
            return run(key, rows, links)
        return two if task == "_permuted_sums" else one
    monkeypatch.setattr(pt, task, told)
    v = spark.createDataFrame([(i, g, float((i * 7 + g) % 11)) for g in range(12) for i in range(6)], "id int, g int, v double")
    points = v.select("id", F.col("id").cast("double").alias("x")).distinct()
    links = proximity.proximity(points, "id", "x", "x", 2.0) if task != "_permuted_sums" else spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int")
    run = pt.local_moran_permutation if task == "_conditional_counts" else pt.moran_permutation
    assert len(run(v, links, "id", "v", ["g"], 50).collect()) == (72 if task == "_conditional_counts" else 12)
    assert len(list(tmp_path.iterdir())) > 1


def test_permuted_orders_are_uniform():
    counts = np.zeros((12, 12))
    for rep in range(1, 4001):
        counts[np.arange(12), pt._order(12, rep, 7)] += 1
    assert ((counts - 4000 / 12) ** 2 / (4000 / 12)).sum() < 200  # 121 degrees of freedom


def test_factors_and_pca_reproduce_dense_algebra(spark):
    rng = np.random.default_rng(6)
    y = rng.normal(size=(50, 6)) + np.outer(rng.normal(size=50), np.arange(6))
    df = spark.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(50), 6), "t": np.tile(np.arange(6), 50), "y": y.ravel()}))
    x = y - y.mean(axis=1, keepdims=True)
    x2 = x - x.mean(axis=0)
    for flag, m in ((False, x), (True, x2)):
        sv = np.linalg.svd(m, compute_uv=False) ** 2
        shares, _, scores = pt.time_factors(df, "i", "t", "y", flag)
        assert [r.share for r in shares.orderBy("component").collect()] == pytest.approx(list(sv / sv.sum()), abs=1e-10)
        f1 = np.array([r.f1 for r in scores.orderBy("i").collect()])
        assert (f1 ** 2).sum() == pytest.approx(sv[0])
    wide = spark.createDataFrame(pd.DataFrame(y, columns=list("abcdef")))
    eig, _, _ = correlation.pca(wide, list("abcdef"))
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(y.T)))[::-1] * 50 / 49
    assert [r.eigenvalue for r in eig.orderBy("component").collect()] == pytest.approx(list(want))


def test_spanned_regressors_are_dropped_and_named(spark):
    rng = np.random.default_rng(8)
    rows = [(i, t, float(x), float(3 * x + 0.1), float(2 * x + i + t + e)) for i in range(12) for t in range(6) for x, e in [(rng.normal(), rng.normal() / 10)]]
    df = spark.createDataFrame(rows, "i long, t long, x double, x2 double, y double")
    both = reg.fit(df, "y", ["x", "x2"], [["i"], ["t"]], [["i"]])
    alone = reg.fit(df, "y", ["x"], [["i"], ["t"]], [["i"]])
    assert both.terms == ["x"] and both.dropped == ["x2"]
    assert both.beta[0] == pytest.approx(alone.beta[0], rel=1e-12) and both.vcov[0, 0] == pytest.approx(alone.vcov[0, 0], rel=1e-12)


def test_panel_tests_use_complete_cases(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=(6, 10)).cumsum(axis=1)
    holes = {(0, 3), (2, 3), (4, 7), (5, 3)}
    rows = [(i, t, float(y[i, t])) for i in range(6) for t in range(10) if (i, t) not in holes] + [(1, 20, float("nan"))]
    df = spark.createDataFrame(rows, "i long, t long, y double")
    full = spark.createDataFrame([(i, t, float(y[i, t])) for i in range(6) for t in range(10) if t not in (3, 7)], "i long, t long, y double")
    assert pt.pesaran_cd(df, "i", "t", "y").first().cd == pytest.approx(pt.pesaran_cd(full, "i", "t", "y").first().cd)
    for test in (pt.hadri, pt.harris_tzavalis):
        a, b = test(df, "i", "t", "y", remove_period_means=True).first(), test(full, "i", "t", "y", remove_period_means=True).first()
        assert a.n == b.n == 6 and a.z == pytest.approx(b.z)
    assert pt.combined_adf(df, "i", "t", "y").first().n == 2


def test_panels_without_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], "e long, l long, y double")
    for test in (pt.harris_tzavalis, pt.hadri, pt.combined_adf):
        row = test(empty, "e", "l", "y").first()
        assert row.n == 0 and row.z is None and row.p is None
    rng = np.random.default_rng(3)
    y = rng.normal(size=(8, 9))
    df = spark.createDataFrame([(i, t, float(y[i, t])) for i in range(8) for t in range(9)], "e long, l long, y double")
    plain = df.toDF("i", "t", "y")
    for test in (pt.harris_tzavalis, pt.hadri, pt.combined_adf):
        assert test(df, "e", "l", "y").first() == test(plain, "i", "t", "y").first()


def test_bootstrap_refuses_panels_with_holes(panel):
    df, _ = panel
    data = reg.prepare(df.where("NOT (area = 'L3M2' AND year = 4)"), ["y", "x"], [["area"], ["year"]], ["lad", "year"])
    with pytest.raises(ValueError):
        reg.wild_cluster_bootstrap(data, "y", "x", "lad", "year", 9)


def test_specification_grid_equals_single_fits(panel, monkeypatch):
    from terrapanel.operators import specgrid
    df, _ = panel
    monkeypatch.setattr(specgrid, "HELD", 4000)  # several hand-overs a task
    structures = {"ey": [["area"], ["year"]], "aly": [["area"], ["lad", "year"]]}
    sets = specgrid.every_subset(["z", "w"])
    assert list(sets) == ["z", "w", "z+w"]
    terms, joint, marginal = specgrid.specification_grid(df, "y", "x", ["z", "w"], sets, structures, ["lad"], "year", list(range(8)), 2)
    got = {(r.spec, r.term): r for r in terms.collect()}
    tests, effects = {r.spec: r for r in joint.collect()}, {(r.spec, r.z): r for r in marginal.collect()}
    assert len(got) == 4 * (2 + 2 + 3) and len(tests) == 12 and len(effects) == 4 * 2 * 3
    wide = df.withColumns({"x_z": F.col("x") * F.col("z"), "x_w": F.col("x") * F.col("w")})
    wide, z_years = reg.period_interactions(wide, "z", "year", list(range(8)), 2)
    for spec, xs, fes in (("ey_plain_z+w", ["x", "x_z", "x_w"], structures["ey"]), ("ey_periods_z", ["x", "x_z", *z_years], structures["ey"]), ("aly_plain_z", ["x", "x_z"], structures["aly"])):
        f = reg.fit(wide, "y", xs, fes, [["lad"]])
        for row in f.rows():
            if row[1] in ("x", "x_z", "x_w"):
                assert got[spec, row[1]].coef == pytest.approx(row[2], rel=1e-8) and got[spec, row[1]].se == pytest.approx(row[3], rel=1e-8)
        w = f.wald([t for t in ("x_z", "x_w") if t in xs])
        assert tests[spec].wald_chi2 == pytest.approx(w["wald_chi2"], rel=1e-7) and tests[spec].q == w["q"]
        if "x_w" not in xs:
            assert effects[spec, -1.0].estimate == pytest.approx(f.lincom({"x": 1.0, "x_z": -1.0})["estimate"], rel=1e-8)
    family = [r for r in got.values() if r.structure == "ey" and not r.controls and r.n_moderators == 2 and r.term != "x"]
    small, large = sorted(r.p for r in family)
    assert sorted(r.p_holm for r in family) == pytest.approx(sorted([min(1, 2 * small), max(min(1, 2 * small), large)]))
    assert all(r.p_holm is None for r in got.values() if r.term == "x")
    none, _, _ = specgrid.specification_grid(df.where("year < 0"), "y", "x", ["z"], {"z": ["z"]}, {"ey": structures["ey"]}, ["lad"], "year", list(range(8)), 2)
    assert {(r.coef, r.n_obs) for r in none.collect()} == {(None, 0)}


def test_ladder_equals_single_fits(panel):
    df, _ = panel
    structures = {"none": [], "year": [["year"]], "both": [["area"], ["year"]], "nested": [["area"], ["lad", "year"]]}
    rows = {r.spec: r for r in reg.ladder(df, "y", ["x"], structures, {"lad": ["lad"], "area": ["area"]}).collect()}
    for name, fes in structures.items():
        for by in ("lad", "area"):
            one = reg.fit(df, "y", ["x"], fes, [[by]]).rows()[0]
            assert rows[f"{name}_{by}"].coef == pytest.approx(one[2], rel=1e-12) and rows[f"{name}_{by}"].se == pytest.approx(one[3], rel=1e-12)
