"""Spatial joins against brute force, including crowded cells and co-located points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import edges, spatial


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.uniform(0, 1000, (120, 2)), rng.normal(500, 1, (60, 2)), np.repeat([[250.0, 250.0]], 40, axis=0), [[90000.0, -5000.0]]])
    return spark.createDataFrame([(i, float(a), float(b), float(i % 7)) for i, (a, b) in enumerate(xy)], "id long, x double, y double, v double").cache(), xy


def test_pairs_match_brute_force(cloud):
    df, xy = cloud
    got = {(r.src, r.dst): r.distance for r in spatial.distance_pairs(df, "id", "x", "y", 60.0).collect()}
    d = np.hypot(*(xy[:, None, :] - xy[None, :, :]).transpose(2, 0, 1))
    want = {(i, j) for i in range(len(xy)) for j in range(len(xy)) if i != j and d[i, j] <= 60.0}
    assert set(got) == want and all(abs(got[k] - d[k]) < 1e-9 for k in want)


def test_decay_weights_along_a_line(spark):
    at = [0.0, 700.0, 1500.0, 2600.0, 9000.0]
    df = spark.createDataFrame(list(enumerate(at)), "id int, x double").withColumn("y", F.lit(0.0))
    p = edges.add_decay(spatial.distance_pairs(df, "id", "x", "y", 1600.0), 500.0, {"near": 1000.0})
    got = {(x.src, x.dst): x for x in p.collect()}
    want = {(i, j): abs(a - b) for i, a in enumerate(at) for j, b in enumerate(at) if i != j and abs(a - b) <= 1600}
    assert got.keys() == want.keys()
    for (i, j), d in want.items():
        near = [w for (a, _), w in want.items() if a == i]
        assert got[i, j].weight_exp == pytest.approx(np.exp(-d / 500)) and got[i, j].near == (d <= 1000)
        assert got[i, j].weight_exp_rownorm == pytest.approx(np.exp(-d / 500) / np.exp(-np.array(near) / 500).sum())


def test_location_exposure_equals_pairwise_sum(cloud):
    df, xy = cloud
    got = {r.id: r for r in spatial.location_exposure(df, "id", "x", "y", ["v"], 60.0, F.exp(-F.col("distance") / 20.0)).collect()}
    d = np.hypot(*(xy[:, None, :] - xy[None, :, :]).transpose(2, 0, 1))
    w = np.where((d <= 60.0) & ~np.eye(len(xy), dtype=bool), np.exp(-d / 20.0), 0.0)
    v = np.arange(len(xy)) % 7
    for i in range(len(xy)):
        assert got[i].nbr_v == pytest.approx((w @ v)[i], abs=1e-9) and got[i].nbr_n == pytest.approx(w.sum(axis=1)[i], abs=1e-9)


@pytest.mark.parametrize("same", [False, True])
def test_nearest_matches_brute_force(cloud, same):
    df, xy = cloud
    got = {r.id: (r.target, r.distance) for r in spatial.nearest_point(df, df.where("id % 3 <> 1") if not same else df, "id", "id", "x", "y", exclude_same=same).collect()}
    d = np.hypot(*(xy[:, None, :] - xy[None, :, :]).transpose(2, 0, 1))
    for i in range(len(xy)):
        ok = [j for j in range(len(xy)) if (j != i if same else j % 3 != 1)]
        best = min(ok, key=lambda j: (round(d[i, j], 9), j))
        assert got[i][1] == pytest.approx(d[i, best], abs=1e-9)
        if not same or d[i, best] > 0:
            assert got[i][0] == best


def ring(*pts):
    return [{"x": float(a), "y": float(b)} for a, b in pts]


SHAPE = "id string, rings array<array<struct<x: double, y: double>>>"


def test_overlay_shares(spark):
    squares = spark.createDataFrame([("a", [ring((0, 0), (100, 0), (100, 100), (0, 100), (0, 0))]), ("b", [ring((100, 0), (200, 0), (200, 100), (100, 100))])], SHAPE)
    layer = spark.createDataFrame([("l", [ring((0, 0), (150, 0), (150, 40), (0, 40))])], SHAPE)
    got = {r.id: r.share for r in spatial.overlay_share(squares, layer, "id", "rings", "rings", cell=70.0).collect()}
    assert got["a"] == pytest.approx(0.4) and got["b"] == pytest.approx(0.2)


def test_overlay_concave_hole_and_winding(spark):
    # an L of area 300, wound clockwise; a frame with a square hole; a triangle across both
    ell = ring((0, 0), (0, 20), (10, 20), (10, 10), (20, 10), (20, 0))
    frame = [ring((30, 0), (50, 0), (50, 20), (30, 20)), ring((35, 5), (35, 15), (45, 15), (45, 5))]
    shapes = spark.createDataFrame([("L", [ell]), ("F", frame)], SHAPE)
    areas = {r.id: r.area for r in spatial.shape_areas(shapes, "id", "rings").collect()}
    assert areas == {"L": 300.0, "F": 300.0}
    tri = [(0.0, 0.0), (50.0, 0.0), (0.0, 25.0)]
    layer = spark.createDataFrame([("t", [ring(*tri)])], SHAPE)
    xs = (np.arange(2000) + 0.5) / 2000 * 50
    ys = (np.arange(1000) + 0.5) / 1000 * 25
    gx, gy = np.meshgrid(xs, ys)
    under = gy < 25 - gx / 2
    in_l = ((gx < 10) & (gy < 20)) | ((gx < 20) & (gy < 10))
    in_f = (gx > 30) & (gx < 50) & (gy < 20) & ~((gx > 35) & (gx < 45) & (gy > 5) & (gy < 15))
    cell_area = 50 / 2000 * 25 / 1000
    for cell in (7.0, 1000.0):
        got = {r.id: r.overlap_area for r in spatial.overlay_share(shapes, layer, "id", "rings", "rings", cell=cell).collect()}
        assert got["L"] == pytest.approx((under & in_l).sum() * cell_area, abs=0.2)
        assert got["F"] == pytest.approx((under & in_f).sum() * cell_area, abs=0.2)


def test_overlapping_layer_parts_count_once(spark):
    """Two equal triangles over a square give the share of one, and crossing parts of any number that of their union."""
    square = spark.createDataFrame([(1, [ring((0, 0), (10, 0), (10, 10), (0, 10))]), (2, [ring((20, 0), (30, 0), (30, 10), (20, 10))])], "id long, rings array<array<struct<x:double,y:double>>>")
    triangle = [ring((0, 0), (10, 0), (0, 6))]
    twice = spark.createDataFrame([("a", triangle), ("a", triangle)], SHAPE)
    assert {r.id: r.share for r in spatial.overlay_share(square, twice, "id", "rings", "rings", 4.0).collect()} == {1: pytest.approx(0.3), 2: 0.0}
    rng = np.random.default_rng(2)
    spikes = [(str(i), [ring(*[tuple(map(float, p)) for p in rng.uniform(-2, 12, (3, 2))])]) for i in range(12)]
    xs = (np.arange(2000) + 0.5) / 200
    gx, gy = np.meshgrid(xs, xs)
    inside = np.zeros(gx.shape, bool)
    for _, (r,) in spikes:
        (ax, ay), (bx, by), (cx, cy) = [(p["x"], p["y"]) for p in r[:3]]
        signs = [(bx - ax) * (gy - ay) - (by - ay) * (gx - ax), (cx - bx) * (gy - by) - (cy - by) * (gx - bx), (ax - cx) * (gy - cy) - (ay - cy) * (gx - cx)]
        inside |= np.all([v >= 0 for v in signs], axis=0) | np.all([v <= 0 for v in signs], axis=0)
    got = spatial.overlay_share(square, spark.createDataFrame(spikes, SHAPE), "id", "rings", "rings", 3.0).where("id = 1").first()
    assert got.share == pytest.approx(inside.mean(), abs=1e-3)


def test_busy_tiles_are_split(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BUSY", 60)
    strips = [(str(i), [ring((i * 0.5, 0), (i * 0.5 + 1, 0), (i * 0.5 + 1, 50), (i * 0.5, 50))]) for i in range(150)]
    layer = spark.createDataFrame(strips, SHAPE)
    shape = spark.createDataFrame([("s", [ring((10, 10), (90, 10), (90, 60), (10, 60))])], SHAPE)
    got = {r.id: r.met for r in spatial.layer_cover(shape, layer, "id", "rings", "rings", 128.0).collect()}
    assert got["s"] == pytest.approx((75.5 - 10) * 40) and got[None] == pytest.approx(75.5 * 50)
    row = spatial.layer_reconciliation(shape, layer, "id", "rings", "id", "rings", 10_000.0, 128.0).first()
    assert (row.n_polygons, row.summed_area, row.dissolved_area) == (150, pytest.approx(7500), pytest.approx(3775)) and row.summed_vs_official == pytest.approx(0.75)


def test_upright_edges_of_few_heights_stay_in_a_tile(spark):
    """Strips of one row need no tile of their own, however many there are; slanted edges and many heights do."""
    upright = [(0, 0, [{"x": float(x), "y": y} for x, y in ((i, 0.0), (i + 2, 0.0), (i + 2, 50.0), (i, 50.0))]) for i in range(1500)]
    slanted = [(1, 0, [{"x": float(x), "y": y} for x, y in ((i, 0.0), (i + 2, 0.0), (i + 9, 50.0), (i + 3, 50.0))]) for i in range(1500)]
    steps = [(2, 0, [{"x": float(x), "y": float(y)} for x, y in ((i, i), (i + 2, i), (i + 2, i + 50), (i, i + 50))]) for i in range(1500)]
    pieces = spark.createDataFrame(upright + slanted + steps, "tx int, ty int, ring array<struct<x: double, y: double>>")
    assert sorted(r.tx for r in spatial._busy_tiles(pieces).collect()) == [1, 2]


def test_many_strips_match_their_union(spark):
    rng = np.random.default_rng(8)
    at = rng.integers(0, 4000, 3000)
    layer = spark.createDataFrame([(str(i), [ring((x, 0), (x + 7, 0), (x + 7, 50), (x, 50))]) for i, x in enumerate(map(int, at))], SHAPE)
    shapes = spark.createDataFrame([(str(k), [ring((k * 500, 10), (k * 500 + 500, 10), (k * 500 + 500, 60), (k * 500, 60))]) for k in range(9)], SHAPE)
    on = np.zeros(4100, bool)
    for x in at:
        on[x:x + 7] = True
    got = {r.id: r.met for r in spatial.layer_cover(shapes, layer, "id", "rings", "rings", 2048.0).collect()}
    assert {k: got[str(k)] for k in range(8)} == {k: pytest.approx(on[k * 500:k * 500 + 500].sum() * 40) for k in range(8)} and got[None] == pytest.approx(on.sum() * 50)


def test_nearest_shape_is_zero_inside_and_respects_holes(spark):
    shapes = spark.createDataFrame([("F", [ring((30, 0), (50, 0), (50, 20), (30, 20)), ring((35, 5), (35, 15), (45, 15), (45, 5))]), ("G", [ring((0, 0), (5, 0), (5, 5))])], SHAPE)
    pts = spark.createDataFrame([(1, 32.0, 3.0), (2, 40.0, 10.0), (3, 60.0, 10.0), (4, 10.0, 0.0)], "k int, x double, y double")
    got = {r.k: (r.target, round(r.distance, 9)) for r in spatial.nearest_shape(pts, shapes, "k", "x", "y", "id", "rings", 10.0).collect()}
    assert got == {1: ("F", 0.0), 2: ("F", 5.0), 3: ("F", 10.0), 4: ("G", 5.0)}


def test_contiguity_islands(spark):
    s = spark.createDataFrame([("a", [ring((0, 0), (1, 0), (1, 1), (0, 1))]), ("b", [ring((1, 1), (2, 1), (2, 2), (1, 2))]), ("z", [ring((9, 9), (10, 9), (10, 10))])], SHAPE)
    e = spatial.contiguity(s, "id", "rings")
    assert sorted(map(tuple, e.collect())) == [("a", "b"), ("b", "a")]
    pts = spark.createDataFrame([("a", 0.5, 0.5), ("b", 1.5, 1.5), ("z", 9.5, 9.5)], "id string, x double, y double")
    full = spatial.attach_islands(e, pts, "id", "x", "y")
    assert sorted((r.src, r.dst) for r in full.where("edge_type = 'island_fallback'").collect()) == [("b", "z"), ("z", "b")]
    assert edges.not_reciprocal(full).count() == 0


def test_nearest_segment_with_shared_midpoints_and_copies(spark):
    rng = np.random.default_rng(4)
    spokes = [(i, *(float(x * r) for x in (-np.cos(i), -np.sin(i), np.cos(i), np.sin(i)))) for i, r in enumerate(np.linspace(1, 5000, 70))]
    copies = [(1000 + i, 9000.0, 9000.0, 9001.0, 9000.0) for i in range(200)]
    segments = spokes + copies
    points = [(i, float(px), float(py)) for i, (px, py) in enumerate(rng.uniform(-6000, 9500, (40, 2)))]
    got = spatial.nearest_segment(spark.createDataFrame(points, "k long, x double, y double"),
                                  spark.createDataFrame(segments, "target long, ax double, ay double, bx double, by double"), "k", "x", "y").collect()

    def distance(px, py, ax, ay, bx, by):
        t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return float(np.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)))

    want = {k: min((distance(px, py, *s[1:]), s[0]) for s in segments) for k, px, py in points}
    assert len(got) == len(points)
    assert all(abs(r.distance - want[r.k][0]) < 1e-6 and (r.target == want[r.k][1] or abs(distance(*points[r.k][1:], *dict((s[0], s[1:]) for s in segments)[r.target]) - want[r.k][0]) < 1e-6) for r in got)
    assert not any(r.target > 1000 for r in got)


def test_heavy_keys_are_dealt(spark):
    """A cell with most points and a hub with most links: no task joins more than a part of them, and no pair is lost."""
    from terrapanel.operators.joins import dealt_join
    left = spark.range(3000).select((F.col("id") % 2 * F.col("id") % 7).alias("k"), "id")
    right = spark.range(500).select((F.col("id") % 3 * F.col("id") % 7).alias("k"), F.col("id").alias("other"), F.lit(1).alias("__note"))
    got = dealt_join(left, right, ["k"], 100)
    assert sorted(map(tuple, got.select("k", "id", "other").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "other").collect()))
    hub = [(0, i) for i in range(1, 400)] + [(i, 0) for i in range(1, 400)]
    pairs = edges.second_order(spark.createDataFrame(hub, "src int, dst int"))
    assert pairs.count() == 399 * 398
    xy = np.random.default_rng(1).uniform(0, 1, (600, 2))
    near = spatial.distance_pairs(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id int, x double, y double"), "id", "x", "y", 0.5)
    assert near.count() == ((np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= 0.5).sum() - 600)
