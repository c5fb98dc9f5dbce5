"""Sums over points within a radius against the same figures from a table of pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.functions.expressions import rounded_half_up
from terrapanel.operators import edges, paneltests, proximity, spatial

R = 60.0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    xy = np.vstack([rng.uniform(0, 400, (150, 2)), rng.normal(200, 1, (60, 2)), np.repeat([[100.0, 130.0]], 20, axis=0), [[9000.0, -5000.0], [100.0, 190.0]]])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(3, *map(float, xy[3])), (None, 5.0, 5.0), (999, None, 5.0)], "id long, x double, y double")
    groups = spark.createDataFrame([(i, None if i % 11 == 0 else f"g{i % 3}") for i in range(len(xy))], "id long, g string")
    rows = [(i, t, None if (i + t) % 5 == 0 else float((i * 7 + t) % 13), float(i % 4)) for i in range(len(xy)) for t in range(3) if (i + t) % 7]
    return points.cache(), groups, spark.createDataFrame(rows, "id long, t int, v double, b double").cache(), xy


@pytest.mark.parametrize("product", [proximity.near_sums, proximity.indicator_product])
@pytest.mark.parametrize("across, scale", [(False, None), (True, None), (False, 20.0), (True, 20.0)])
def test_sums_match_brute_force(cloud, product, across, scale):
    xy = cloud[3]
    n = len(xy)
    p = proximity.Places(xy[:, 0], xy[:, 1], np.arange(n), np.arange(n) % 3)
    v, u = np.random.default_rng(1).normal(size=(n, 4)), np.ones((n, 1))
    plain, heavy = product(p.take(np.arange(0, n, 2)), p, u, v, R, across, scale)
    d = np.hypot(*(xy[:, None, :] - xy[None, :, :]).transpose(2, 0, 1))
    link = (d <= R) & ~np.eye(n, dtype=bool) & ((p.group[:, None] != p.group) | (not across))
    w = link * (np.exp(-d / scale) if scale else 1.0)
    assert np.array_equal(plain, (link @ u)[::2]) and np.allclose(heavy, (w @ v)[::2], atol=1e-9)


@pytest.mark.parametrize("cross", [False, True])
@pytest.mark.parametrize("weight", [None, "weight_exp"])
@pytest.mark.parametrize("crowd", [False, True])
def test_aggregates_equal_those_of_pairs(cloud, monkeypatch, cross, weight, crowd):
    if crowd:
        monkeypatch.setattr(proximity, "SOURCES", 20)
        monkeypatch.setattr(proximity, "OTHERS", 90)
    points, groups, values, _ = cloud
    aggs = {"rate": edges.pooled_rate("v", "b"), "mean": edges.neighbour_mean("v"), "level": edges.weighted_level("v", "b"), "sum": edges.neighbour_sum("v"), "k": edges.neighbour_count(), **edges.sale_weighted("v", "b")}

    def result(e):
        e = edges.mark_groups(e, groups, "id", "g")
        e = edges.across_groups(e) if cross else e
        e = edges.add_decay(e, 20.0, {}) if weight else e
        return sorted(map(tuple, edges.neighbour_aggregate(e, values, "id", "t", aggs, weight).collect()))
    got, want = result(proximity.proximity(points, "id", "x", "y", R)), result(spatial.distance_pairs(points, "id", "x", "y", R))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert [x is None for x in a] == [x is None for x in b]
        assert [x for x in a if x is not None] == pytest.approx([x for x in b if x is not None])


def test_crowded_tiles_send_values_to_nine_tiles_only(spark):
    """A tile of 5,000 points is one part of sources: its rows are not sent again for each 2,048 of them."""
    nodes = spark.range(5000).selectExpr("id", "id % 71 * 1.0D AS x", "id % 73 * 1.0D AS y", "CAST(NULL AS string) AS group", "0L AS tx", "0L AS ty")
    others = nodes.crossJoin(spark.range(7).withColumnRenamed("id", "__by0"))
    left, right, keys = proximity._dealt(nodes, others)
    assert right.count() == others.count() and left.select(*keys).distinct().count() == 1
    many = nodes.crossJoin(spark.range(100).withColumnRenamed("id", "__by0"))
    assert {r["__s"] for r in proximity._dealt(nodes, many)[0].select("__s").distinct().collect()} == {0, 1, 2}


def test_panel_tests_equal_those_of_pairs(cloud):
    points, _, values, _ = cloud
    near, listed = proximity.proximity(points, "id", "x", "y", R), spatial.distance_pairs(points, "id", "x", "y", R)
    panel = values.withColumn("v", F.coalesce("v", F.lit(2.5))).withColumn("t", F.when((F.col("t") < 2) | (F.col("id") % 2 == 0), F.col("t")))
    whole = panel.where("t < 9").unionByName(panel.groupBy("id").agg(F.lit(7).alias("t"), F.max("v").alias("v"), F.max("b").alias("b"))).unionByName(panel.groupBy("id").agg(F.lit(8).alias("t"), F.min("v").alias("v"), F.max("b").alias("b")))
    for run in (lambda e: paneltests.morans_i(panel, e, "id", "v", ["t"]), lambda e: paneltests.moran_permutation(panel, e, "id", "v", ["t"], 130, 9),
                lambda e: paneltests.local_moran(panel, e, "id", "v", ["t"]).select("id", "t", "wz", "degree", "local_i"), lambda e: paneltests.neighbour_correlation(whole, e, "id", "t", "v")):
        got, want = (sorted(map(tuple, run(e).collect()), key=lambda r: [(x is None, round(x or 0.0, 6)) for x in r]) for e in (near, listed))
        assert len(got) == len(want) > 0
        for a, b in zip(got, want):
            assert [x is None for x in a] == [x is None for x in b]
            assert [x for x in a if x is not None] == pytest.approx([x for x in b if x is not None], abs=1e-9)


def test_recomputation_by_the_definition(cloud):
    points, _, values, _ = cloud
    e = proximity.proximity(points, "id", "x", "y", R)
    stored = edges.neighbour_aggregate(e, values, "id", "t", {"total": edges.neighbour_sum("v")})
    assert edges.recompute_sample(e, values, stored, "id", "t", "v", "total", 1).where("NOT ok").count() == 0
    wrong = stored.withColumn("total", F.when(F.col("id") == 5, F.col("total") + 1).otherwise(F.col("total")))
    assert edges.recompute_sample(e, values, wrong, "id", "t", "v", "total", 1).where("NOT ok").select("id").distinct().collect() == [(5,)]


def listed(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(params=[False, True])
def parts(request, monkeypatch):
    """Once with the sizes of tasks as they are, once with many parts of a tile and of its middles."""
    if request.param:
        monkeypatch.setattr(proximity, "LISTED", 25)
        monkeypatch.setattr(proximity, "MIDDLES", 20)


@pytest.mark.parametrize("cross", [False, True])
def test_lists_equal_those_of_pairs(cloud, parts, cross):
    points, groups, _, _ = cloud
    both = []
    for e in (proximity.proximity(points, "id", "x", "y", R), spatial.distance_pairs(points, "id", "x", "y", R)):
        e = edges.across_groups(edges.mark_groups(e, groups, "id", "g")) if cross else e
        e = e if isinstance(e, proximity.Proximity) else e.select("src", "dst")
        some = e.where("(src * 31 + dst) % 7 <> 0")
        both.append([listed(proximity.links(e) if isinstance(e, proximity.Proximity) else e), listed(edges.not_reciprocal(some)), listed(edges.second_order(e)),
                     listed(edges.edge_report(e)), listed(edges.edge_report(some)), listed(edges.edge_report(some.unionByName(some))), listed(edges.edge_report(e.unionByName(e)))])
    for got, want in zip(*both):
        assert got == want and len(want) > 0


def test_lists_of_ids_at_several_places(spark, cloud):
    points = cloud[0].unionByName(spark.createDataFrame([(7, 100.0, 140.0), (9, 8990.0, -5000.0)], "id long, x double, y double"))
    near, pairs = proximity.proximity(points, "id", "x", "y", R), spatial.distance_pairs(points, "id", "x", "y", R).select("src", "dst")
    assert listed(edges.second_order(near)) == listed(edges.second_order(pairs.where("src <> dst")))
    assert listed(edges.edge_report(near)) == listed(edges.edge_report(pairs.where("src <> dst")))


def test_a_pair_reached_by_a_single_middle(spark, parts):
    """Two points almost two radii apart: only the one between reaches both, also if it stands in a cell with others."""
    rows = [(i, 0.5 * i, 40.0) for i in range(40)] + [(100, 0.0, 0.0), (101, 119.9999, 0.0), (102, 59.99995, 0.0), (103, 59.9, 0.0), (104, 240.5, 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    got = {(a, b) for a, b in listed(edges.second_order(proximity.proximity(points, "id", "x", "y", R)))}
    assert (100, 101) in got and (101, 100) in got and not any(104 in p for p in got)
    assert listed(edges.second_order(proximity.proximity(points.where("id <> 102"), "id", "x", "y", R))) == listed(edges.second_order(spatial.distance_pairs(points.where("id <> 102"), "id", "x", "y", R)))


def test_repeated_links_are_refused(spark, cloud):
    near = proximity.proximity(cloud[0], "id", "x", "y", R)
    with pytest.raises(ValueError, match="duplicated"):
        edges.validate_edges(near)
    assert edges.validate_edges(near.distinct()).distinct().times == 1
    with pytest.raises(ValueError, match="same links"):
        near.unionByName(proximity.proximity(cloud[0], "id", "x", "y", 2 * R))


def test_lists_are_not_shuffled(cloud, capsys):
    """No exchange and no join after the links are made."""
    near = proximity.proximity(cloud[0].where("id <> 3"), "id", "x", "y", R)
    for made in (edges.not_reciprocal(near.where("src % 7 <> dst % 5")), edges.second_order(near)):
        made.explain()
        plan = capsys.readouterr().out
        assert "CoGroups" in plan and not any(w in plan.split("CoGroups")[0] for w in ("Exchange", "Join"))


@pytest.mark.parametrize("n, copies, span", [(400, 1, 6000.0), (1500, 3, 4000.0), (300, 2, 300.0), (1200, 1, 30000.0), (0, 1, 1.0)])
def test_forms_equal_the_definition_and_compare_few_points(n, copies, span, monkeypatch):
    rng = np.random.default_rng(n + copies)
    x, y = (np.repeat(np.round(rng.random(n) * span, -2), copies) for _ in range(2))
    p = proximity.Places(x, y, np.repeat(np.arange(n), copies), np.zeros(n * copies, np.int64))
    compared = {"forms": 0, "sums": 0}

    def counted(name, f):
        def run(*args):
            out = f(*args)
            compared[name] += (out if name == "forms" else out[0]).size
            return out
        return run
    monkeypatch.setattr(proximity, "_both_shares", counted("forms", proximity._both_shares))
    monkeypatch.setattr(proximity, "_near", counted("sums", proximity._near))
    values, shares = rng.normal(size=(n * copies, 4)), rng.random(n * copies)
    whole = proximity.near_forms(p, shares, values, 1500.0)
    around, _ = proximity.near_sums(p, p, values, np.zeros((n * copies, 0)), 1500.0)
    assert 3 * compared["forms"] <= compared["sums"]
    around_by_definition, _ = proximity.indicator_product(p, p, values, np.zeros((n * copies, 0)), 1500.0)
    want = (shares[:, None] * values * around_by_definition).sum(axis=0)
    assert whole == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert (shares[:, None] * values * around).sum(axis=0) == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert sum(proximity.near_forms(p, shares, values, 1500.0, k, 4) for k in range(4)) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_forms_of_ids_at_several_places():
    rng = np.random.default_rng(5)
    p = proximity.Places(rng.random(400) * 6000, rng.random(400) * 6000, rng.integers(0, 200, 400), np.zeros(400, np.int64))
    values, shares = rng.normal(size=(400, 3)), rng.random(400)
    want = (shares[:, None] * values * proximity.indicator_product(p, p, values, np.zeros((400, 0)), 1500.0)[0]).sum(axis=0)
    assert sum(proximity.near_forms(p, shares, values, 1500.0, k, 3) for k in range(3)) == pytest.approx(want, rel=1e-9)


def test_block_of_permutations():
    """Entities without links keep their value and take part in the reassignment."""
    rows = pa.table({"t": [1] * 5, "__block": [0] * 5, "__part": [0] * 5, "__e": list(range(5)), "__i": [1, 2, 3, 4, 5], "__z": [-3.0, 1.0, 0.5, 2.5, -1.0],
                     "__degree": [1, 2, 1, None, None], "__x": [0.0, 1000.0, 2000.0, 9e5, None], "__y": [0.0, 0.0, 0.0, 9e5, None]})
    got = paneltests._permuted_near(["t"], 30, 7, 1500.0)((pa.scalar(1), pa.scalar(0), pa.scalar(0)), rows)
    assert got["rep"].to_pylist() == list(range(1, 31))
    for rep, s in zip(got["rep"].to_pylist(), got["s"].to_pylist()):
        z = rows["__z"].to_numpy()[np.argsort(paneltests.mixed(np.arange(1, 6), rep, 7), kind="stable")]
        assert s == pytest.approx(z[0] * z[1] + z[1] * (z[0] + z[2]) / 2 + z[2] * z[1])


@pytest.mark.parametrize("cross, twice", [(False, False), (True, True)])
def test_weighted_links_equal_those_of_pairs(cloud, cross, twice):
    """Links are not shuffled after they are found, unless an id stands at two places."""
    points, groups, _, _ = cloud
    p = points.unionByName(points.where("id < 40")).unionByName(points.where("id = 8").withColumn("x", F.col("x") + 20)) if twice else points
    both = []
    for e in (proximity.proximity(p, "id", "x", "y", R), spatial.distance_pairs(p, "id", "x", "y", R)):
        e = edges.across_groups(edges.mark_groups(e, groups, "id", "g")) if cross else e
        e = edges.weighted_links(edges.add_decay(e, 20.0, {"near": 30.0}))
        both.append(e.where("src <> dst").select("src", "dst", "distance", "near", "weight_exp", "weight_exp_rownorm"))
    got, want = ([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in listed(e)] for e in both)
    assert got == want and len(want) > 1000
    after = both[0]._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert twice or ("Exchange" not in after and "Join" not in after)


def test_weighted_links_with_a_condition(cloud):
    some = edges.add_decay(proximity.proximity(cloud[0], "id", "x", "y", R), 20.0, {}).where("(src + dst) % 3 = 0")
    total = edges.weighted_links(some).groupBy("src").agg(F.sum("weight_exp_rownorm").alias("s"))
    assert [round(r["s"], 9) for r in total.collect()] == [1.0] * proximity.links(some).select("src").distinct().count()


def test_rounding_gives_the_bits_of_round(spark):
    rng = np.random.default_rng(3)
    x = [0.0, -0.0, 1e-12, -1e-12, 2.0 ** 53, 1e30, -1e300, float("nan"), float("inf"), -float("inf"), None, 1.005, 0.125, -0.125]
    x += [*map(float, np.exp(rng.uniform(-12, 3, 2000)))] + [k * 5 / 10 ** 11 for k in range(-500, 500)] + [k * 5 / 1000 for k in range(-300, 300)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for digits in (2, 10):
        both = df.select(*[c.cast("string") for c in (F.round("x", digits), rounded_half_up(F.col("x"), digits))]).toDF("want", "got")
        assert both.where("NOT want <=> got").collect() == []
