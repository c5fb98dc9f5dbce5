"""Spatial joins, edge lists and neighbour exposures over deterministic coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.catalog.base import PANEL, POINTS, query, rounded
from terrapanel.functions.expressions import rounded_half_up
from terrapanel.operators import correlation, edges, grid, proximity, spatial
from terrapanel.operators.joins import with_scalars
from terrapanel.session import materialise

R = 15000.0
PAIRS = f"""{POINTS}, pairs AS (SELECT a.area_id AS src, b.area_id AS dst, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS distance
 FROM points a JOIN points b ON a.area_id <> b.area_id AND sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) <= {R})"""
EDGES = f"""{PANEL}, {PAIRS}, edges AS (SELECT src, dst, distance, a.district_id = b.district_id AS same_group, exp(-distance / 5000.0) AS w FROM pairs
 JOIN areas a ON src = a.area_id JOIN areas b ON dst = b.area_id)"""


def pairs(t):
    return spatial.distance_pairs(t.points, "area_id", "px", "py", R)


def edge_list(t):
    return edges.mark_groups(pairs(t), t.areas, "area_id", "district_id")


def nearby(t):
    """The links of ``pairs`` for sums over neighbours and for lists made where points meet: not written out."""
    return proximity.proximity(t.points, "area_id", "px", "py", R)


def nearby_groups(t):
    return edges.mark_groups(nearby(t), t.areas, "area_id", "district_id")


@query("j18_distance_pairs", f"WITH {PAIRS} SELECT src, dst, round(distance, 6) AS distance FROM pairs")
def j18(t):
    return rounded(pairs(t))


@query("j19_nearest_point", f"""WITH {POINTS}, c AS (SELECT c_custkey, CAST((c_custkey * 6007) % 100000 AS DOUBLE) AS px, CAST((c_custkey * 9001) % 100000 AS DOUBLE) AS py FROM customer),
d AS (SELECT c_custkey, area_id, sqrt((c.px - p.px) ** 2 + (c.py - p.py) ** 2) AS d FROM c, points p)
SELECT c_custkey, area_id AS target, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, area_id) AS rn FROM d) WHERE rn = 1""")
def j19(t):
    k = F.col("c_custkey")
    c = t.customer.select(k, F.pmod(k * 6007, F.lit(100000)).cast("double").alias("px"), F.pmod(k * 9001, F.lit(100000)).cast("double").alias("py"))
    return rounded(spatial.nearest_point(c, t.points, "c_custkey", "area_id", "px", "py"))


CELL = 2000
CELLS = f"""cells AS (SELECT DISTINCT CAST(floor(((c_custkey * 7919) % 100000) / {CELL}) AS BIGINT) AS gx, CAST(floor(((c_custkey * 104729) % 100000) / {CELL}) AS BIGINT) AS gy FROM customer),
shapes AS (SELECT gx * 1000 + gy AS cell_id, gx, gy FROM cells)"""


def cell_index(t):
    k = F.col("c_custkey")
    return t.customer.select(F.floor(F.pmod(k * 7919, F.lit(100000)) / CELL).alias("gx"), F.floor(F.pmod(k * 104729, F.lit(100000)) / CELL).alias("gy")).distinct()


def square(x0, y0, w, h):
    def p(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(p(x0, y0), p(x0 + w, y0), p(x0 + w, y0 + h), p(x0, y0 + h), p(x0, y0)))


def shapes(t):
    c = cell_index(t)
    return c.select((F.col("gx") * 1000 + F.col("gy")).alias("cell_id"), "gx", "gy", square(F.col("gx") * CELL, F.col("gy") * CELL, CELL, CELL).alias("rings"))


@query("j19_nearest_polygon", f"""WITH {POINTS}, {CELLS}, d AS (SELECT area_id, cell_id, sqrt(greatest(gx * {CELL} - px, px - (gx + 1) * {CELL}, 0) ** 2 + greatest(gy * {CELL} - py, py - (gy + 1) * {CELL}, 0) ** 2) AS d FROM points, shapes)
SELECT area_id, round(min(d), 6) AS distance FROM d GROUP BY area_id""")
def j19b(t):
    return rounded(spatial.nearest_shape(t.points, shapes(t), "area_id", "px", "py", "cell_id", "rings", float(CELL)).select("area_id", "distance"))


QUEEN = f"""{CELLS}, queen AS (SELECT a.cell_id AS src, b.cell_id AS dst FROM shapes a JOIN shapes b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.cell_id <> b.cell_id)"""


@query("j20_contiguity", f"WITH {QUEEN} SELECT src, dst FROM queen")
def j20(t):
    return spatial.contiguity(shapes(t), "cell_id", "rings")


@query("j21_island_fallback", f"""WITH {QUEEN}, alone AS (SELECT * FROM shapes WHERE cell_id NOT IN (SELECT src FROM queen)),
d AS (SELECT a.cell_id AS src, b.cell_id AS dst, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2, b.cell_id) AS rn FROM alone a JOIN shapes b ON a.cell_id <> b.cell_id),
f AS (SELECT src, dst FROM d WHERE rn = 1 UNION SELECT dst, src FROM d WHERE rn = 1)
SELECT src, dst, 'queen' AS edge_type FROM queen UNION ALL SELECT src, dst, 'island_fallback' FROM f""")
def j21(t):
    s = shapes(t).withColumns({"cx": F.col("gx") * CELL + F.lit(CELL / 2.0), "cy": F.col("gy") * CELL + F.lit(CELL / 2.0)})
    return spatial.attach_islands(spatial.contiguity(s, "cell_id", "rings"), s, "cell_id", "cx", "cy")


def layer_sql(width: int = 50, name: str = "u") -> str:
    """Disjoint rectangles of the union of all customers' strips: they overlap only with strips of their own row."""
    return f"""{name}0 AS (SELECT 5000.0 * (c_custkey % 19) AS y0, CAST((c_custkey * 7919) % 100000 AS DOUBLE) AS x0 FROM customer),
{name}1 AS (SELECT *, max(x0 + {width}) OVER (PARTITION BY y0 ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name}0),
{name}2 AS (SELECT *, sum(CASE WHEN before IS NULL OR x0 > before THEN 1 ELSE 0 END) OVER (PARTITION BY y0 ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS g FROM {name}1),
{name} AS (SELECT y0, min(x0) AS x0, max(x0) + {width} AS x1 FROM {name}2 GROUP BY y0, g),
{name}m AS (SELECT cell_id, sum(greatest(0, least((gx + 1) * {CELL}, x1) - greatest(gx * {CELL}, x0)) * greatest(0, least((gy + 1) * {CELL}, y0 + 3000) - greatest(gy * {CELL}, y0))) / {CELL}.0 / {CELL}.0 AS share FROM shapes, {name} GROUP BY 1)"""


def layer(t, width: int = 50):
    """A strip for every customer; many overlap."""
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), square(F.pmod(k * 7919, F.lit(100000)), 5000 * (k % 19), width, 3000).alias("rings"))


@query("j22_overlay_share", f"WITH {CELLS}, {layer_sql()} SELECT cell_id, round(share, 8) AS share FROM um")
def j22(t):
    return rounded(spatial.overlay_share(shapes(t), layer(t), "cell_id", "rings", "rings").select("cell_id", "share"), 8)


RECONCILED = """SELECT '{0}' AS layer, (SELECT count(*) FROM customer) AS n_polygons, (SELECT count(*) FROM customer) * {1}.0::DOUBLE AS summed_area, (SELECT sum(x1 - x0) * 3000 FROM {0}) AS dissolved_area,
 (SELECT count(*) FROM customer) * {1}.0::DOUBLE - (SELECT sum(x1 - x0) * 3000 FROM {0}) AS double_counted, round((SELECT sum(share) FROM {0}m) * {2}, 2) AS area_inside,
 round((SELECT count(*) FROM customer) * {1}.0::DOUBLE / 2e9, 9) AS summed_vs_official, round((SELECT sum(share) FROM {0}m) * {2} / (SELECT sum(x1 - x0) * 3000 FROM {0}), 9) AS share_inside"""


@query("d15_layer_reconciliation", f"WITH {CELLS}, {layer_sql(50, 'u')}, {layer_sql(60, 'v')} " + RECONCILED.format("u", 150000, CELL * CELL) + " UNION ALL " + RECONCILED.format("v", 180000, CELL * CELL))
def d15(t):
    out = None
    for name, width in (("u", 50), ("v", 60)):
        part = spatial.layer_reconciliation(shapes(t), layer(t, width), "cell_id", "rings", "id", "rings", 2e9).select(F.lit(name).alias("layer"), "*")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4, area_inside=2, summed_vs_official=9, share_inside=9)


@query("d15_share_stability", f"""WITH {CELLS}, {layer_sql(50, 'u')}, {layer_sql(60, 'v')}, s AS (SELECT round(um.share, 9) AS a, round(vm.share, 9) AS b FROM um JOIN vm ON um.cell_id = vm.cell_id),
r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM s)
SELECT count(*) AS n, round(corr(a, b), 8) AS pearson, round(corr(ra, rb), 8) AS spearman, round(max(abs(a - b)), 8) AS max_abs_diff, round(avg(abs(a - b)), 8) AS mean_abs_diff, round(avg((a = b)::INT), 8) AS share_identical,
 count(*) FILTER (WHERE abs(a - b) > 0.05) AS n_over FROM r""")
def d15s(t):
    from terrapanel.operators.indexing import agreement
    s = shapes(t)
    one, two = (spatial.overlay_share(s, layer(t, width), "cell_id", "rings", "rings", out=name).select("cell_id", F.round(name, 9).alias(name)) for width, name in ((50, "s1"), (60, "s2")))
    both = materialise(one.join(two, "cell_id"))
    over = both.agg(F.count_if(F.abs(F.col("s1") - F.col("s2")) > 0.05).alias("n_over"))
    return rounded(with_scalars(agreement(both, "s1", "s2"), over), 8)


@query("j23_cross_group_edges", f"WITH {EDGES} SELECT src, dst FROM edges WHERE NOT same_group")
def j23(t):
    return edge_list(t).where("NOT same_group").select("src", "dst")


@query("j24_reciprocity", f"WITH {PAIRS}, e AS (SELECT src, dst FROM pairs WHERE (src * 31 + dst) % 7 <> 0) SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)")
def j24(t):
    return edges.not_reciprocal(nearby(t).where("(src * 31 + dst) % 7 <> 0"))


@query("j25_edge_validation", f"WITH {PAIRS} SELECT count(*) * 2 AS n_edges, CAST(0 AS BIGINT) AS n_self_loops, count(*) AS n_duplicate_pairs FROM pairs")
def j25(t):
    p = edges.validate_edges(nearby(t))
    return edges.edge_report(p.unionByName(p))


@query("j26_second_order", f"WITH {PAIRS} SELECT DISTINCT a.src, b.dst FROM pairs a JOIN pairs b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM pairs c WHERE c.src = a.src AND c.dst = b.dst)")
def j26(t):
    return edges.second_order(nearby(t))


AROUND = f"""{EDGES}, near AS (SELECT p.area_id, p.year, e.w, e.same_group, q.built, q.base, q.rate, q.y, q.n, q.income FROM panel_all p JOIN edges e ON p.area_id = e.src JOIN panel_all q ON q.area_id = e.dst AND q.year = p.year)"""


def neighbours(t, aggs, weight=None, cross=False):
    e = nearby_groups(t)
    e = edges.across_groups(e) if cross else e
    if weight:
        e = edges.add_decay(e, 5000.0, {"within_5km": 5000.0})
    v = t.panel_all.select("area_id", "year", "built", "base", "rate", "y", "n", "income")
    return edges.neighbour_aggregate(e, v, "area_id", "year", aggs, weight)


def n_sql(select: str, where: str = "") -> str:
    return f"WITH {AROUND}, a AS (SELECT area_id, year, {select} FROM near {where} GROUP BY ALL) SELECT p.area_id, p.year, a.* EXCLUDE (area_id, year) FROM panel_all p LEFT JOIN a ON p.area_id = a.area_id AND p.year = a.year"


@query("n01_neighbour_sum", n_sql("CAST(sum(built) AS DOUBLE) AS total").replace("a.* EXCLUDE (area_id, year)", "coalesce(a.total, 0) AS total"))
def n01(t):
    out = neighbours(t, {"total": edges.neighbour_sum("built")})
    return out.withColumn("total", F.coalesce("total", F.lit(0.0)))


@query("n02_pooled_rate", n_sql("round(1000.0 * sum(built) / NULLIF(sum(base), 0), 8) AS pooled"))
def n02(t):
    return rounded(neighbours(t, {"pooled": edges.pooled_rate("built", "base")}), 8)


@query("n02_pooled_rate_cross_group", n_sql("round(1000.0 * sum(built) / NULLIF(sum(base), 0), 8) AS pooled", "WHERE NOT same_group"))
def n02c(t):
    return rounded(neighbours(t, {"pooled": edges.pooled_rate("built", "base")}, cross=True), 8)


@query("n03_neighbour_mean", n_sql("round(avg(rate), 8) AS mean_rate"))
def n03(t):
    return rounded(neighbours(t, {"mean_rate": edges.neighbour_mean("rate")}), 8)


@query("n04_level_gap", f"""WITH {AROUND}, a AS (SELECT area_id, year, sum(income * base) / sum(base) AS lvl FROM near GROUP BY ALL)
SELECT p.area_id, p.year, round(lvl, 7) AS level, round(CASE WHEN p.income > 0 THEN ln(p.income) END - CASE WHEN lvl > 0 THEN ln(lvl) END, 7) AS gap FROM panel_all p LEFT JOIN a ON p.area_id = a.area_id AND p.year = a.year""")
def n04(t):
    out = neighbours(t, {"level": edges.weighted_level("income", "base")})
    own = t.panel_all.select("area_id", "year", "income")
    return rounded(out.join(own, ["area_id", "year"]).select("area_id", "year", "level", edges.log_level_gap(F.col("income"), F.col("level")).alias("gap")), 7)


@query("n05_sale_weighted_price", n_sql("round(sum(n * y) FILTER (WHERE rate > 300) / sum(n) FILTER (WHERE rate > 300), 8) AS mean, count(*) FILTER (WHERE rate > 300) AS n_valid, CAST(coalesce(sum(n) FILTER (WHERE rate > 300), 0) AS DOUBLE) AS total_sales"))
def n05(t):
    e = nearby_groups(t)
    v = t.panel_all.select("area_id", "year", F.when(F.col("rate") > 300, F.col("y")).alias("y"), "n")
    return rounded(edges.neighbour_aggregate(e, v, "area_id", "year", edges.sale_weighted("y", "n")), 8)


@query("n06_decay_exposure", n_sql("round(1000.0 * sum(w * built) / NULLIF(sum(w * base), 0), 7) AS pooled"))
def n06(t):
    return rounded(neighbours(t, {"pooled": edges.pooled_rate("built", "base")}, weight="weight_exp"), 7)


@query("n06_location_exposure", f"""WITH {POINTS}, c AS (SELECT c_custkey, CAST((c_custkey * 7919) % 700 AS DOUBLE) * 100 AS px, CAST((c_custkey * 104729) % 900 AS DOUBLE) * 100 AS py, c_acctbal AS v FROM customer)
SELECT a.c_custkey, round(coalesce(sum(exp(-d / 1000.0) * b.v), 0), 4) AS nbr_v, round(coalesce(sum(exp(-d / 1000.0)), 0), 6) AS nbr_n FROM c a LEFT JOIN
 (SELECT a.c_custkey AS k, b.v, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS d FROM c a JOIN c b ON a.c_custkey <> b.c_custkey AND sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) <= 3000) b ON a.c_custkey = b.k GROUP BY 1""")
def n06b(t):
    k = F.col("c_custkey")
    c = t.customer.select(k, (F.pmod(k * 7919, F.lit(700)) * 100).cast("double").alias("px"), (F.pmod(k * 104729, F.lit(900)) * 100).cast("double").alias("py"), F.col("c_acctbal").alias("v"))
    return rounded(spatial.location_exposure(c, "c_custkey", "px", "py", ["v"], 3000.0, F.exp(-F.col("distance") / 1000.0)), 4, nbr_n=6)


@query("n07_neighbour_counts", f"""WITH {EDGES} SELECT p.area_id, count(e.src) AS n_neighbours, count(*) FILTER (WHERE NOT same_group) AS n_cross, round(coalesce(sum(w), 0), 8) AS weight_sum FROM points p LEFT JOIN edges e ON p.area_id = e.src GROUP BY 1""")
def n07(t):
    return rounded(edges.neighbour_counts(edges.add_decay(edge_list(t), 5000.0, {}), t.points, "area_id"), 8)


@query("n08_undefined_flags", f"WITH {EDGES} SELECT area_id, year, area_id NOT IN (SELECT src FROM edges) AS none, area_id NOT IN (SELECT src FROM edges WHERE NOT same_group) AS cross_none FROM panel_all")
def n08(t):
    out = neighbours(t, {"pooled": edges.pooled_rate("built", "base"), "k": edges.neighbour_count()})
    cross = neighbours(t, {"kc": edges.neighbour_count()}, cross=True)
    return out.join(cross, ["area_id", "year"]).select("area_id", "year", F.col("k").isNull().alias("none"), F.col("kc").isNull().alias("cross_none"))


@query("n09_lagged_exposure", f"""WITH {EDGES}, l AS (SELECT *, lag(built) OVER (PARTITION BY area_id ORDER BY year) AS b1 FROM panel_all), near AS (SELECT e.src AS area_id, q.year, q.b1, q.base FROM edges e JOIN l q ON q.area_id = e.dst), a AS (SELECT area_id, year, round(1000.0 * sum(b1) / NULLIF(sum(base) FILTER (WHERE b1 IS NOT NULL), 0), 8) AS pooled FROM near GROUP BY ALL)
SELECT p.area_id, p.year, pooled FROM panel p LEFT JOIN a ON p.area_id = a.area_id AND p.year = a.year""")
def n09(t):
    v = grid.add_lags(t.panel_all, "area_id", "year", ["built"], [1]).where("year >= 1996").select("area_id", "year", "built_lag1", "base")
    return rounded(edges.neighbour_aggregate(nearby_groups(t), v, "area_id", "year", {"pooled": edges.pooled_rate("built_lag1", "base")}), 8)


@query("w20_exposure_lag", n_sql("avg(rate) AS m").replace("a.* EXCLUDE (area_id, year)", "round(lag(m) OVER (PARTITION BY p.area_id ORDER BY p.year), 8) AS m_lag1"))
def w20(t):
    out = edges.lag_exposure(neighbours(t, {"m": edges.neighbour_mean("rate")}), "area_id", "year", "m", "m_lag1")
    return rounded(out.select("area_id", "year", "m_lag1"), 8)


@query("w22_row_normalised_weights", f"WITH {EDGES} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 10) AS weight_exp_rownorm, distance <= 5000 AS within_5km FROM edges")
def w22(t):
    e = edges.weighted_links(edges.add_decay(nearby(t), 5000.0, {"within_5km": 5000.0}))
    share = rounded_half_up(F.col("weight_exp_rownorm"), 10).alias("weight_exp_rownorm")
    return rounded(e.select("src", "dst", share, "within_5km"), weight_exp_rownorm=None)


@query("n10_exposure_summary", f"""WITH {AROUND}, a AS (SELECT area_id, year, avg(rate) AS m FROM near GROUP BY ALL), j AS (SELECT p.year, p.rate, a.m FROM panel_all p LEFT JOIN a ON p.area_id = a.area_id AND p.year = a.year)
SELECT year, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(avg((m = 0)::INT), 8) AS share_zero, round(corr(rate, m), 8) AS corr_own FROM j GROUP BY year""")
def n10(t):
    from terrapanel.operators.joins import attach
    from terrapanel.operators.quantiles import exact_quantiles
    j = neighbours(t, {"m": edges.neighbour_mean("rate")}).join(t.panel_all.select("area_id", "year", "rate"), ["area_id", "year"])
    s = j.groupBy("year").agg(F.avg("m").alias("mean"), F.avg((F.col("m") == 0).cast("double")).alias("share_zero"), F.corr("rate", "m").alias("corr_own"))
    return rounded(attach(s, exact_quantiles(j, ["year"], "m", {"median": 0.5}), ["year"]), 6, share_zero=8, corr_own=8)


@query("n10_network_summary", f"WITH {EDGES} SELECT count(*) AS n_edges, count(*) FILTER (WHERE NOT same_group) AS n_cross, count(*) FILTER (WHERE distance <= 5000) AS n_within_5km FROM edges")
def n10b(t):
    return edge_list(t).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(~F.col("same_group")).alias("n_cross"), F.count_if(F.col("distance") <= 5000).alias("n_within_5km"))


@query("n11_recomputation_check", f"""WITH {AROUND}, a AS (SELECT area_id, year, sum(built) AS total FROM near GROUP BY ALL),
b AS (SELECT e.src AS area_id, q.year, sum(q.built * 1.0::DOUBLE) AS total FROM edges e JOIN panel_all q ON q.area_id = e.dst GROUP BY ALL)
SELECT count(*) AS n_checked, bool_and(abs(a.total - b.total) <= 1e-9) AS all_ok FROM a JOIN b ON a.area_id = b.area_id AND a.year = b.year""")
def n11(t):
    e = nearby_groups(t)
    v = materialise(t.panel_all.select("area_id", "year", "built"))
    stored = edges.neighbour_aggregate(e, v, "area_id", "year", {"total": edges.neighbour_sum("built")})
    c = edges.recompute_sample(e, v, stored, "area_id", "year", "built", "total", 1)
    return c.agg(F.count(F.lit(1)).alias("n_checked"), F.bool_and("ok").alias("all_ok"))


@query("e37_own_vs_neighbour", f"""WITH {AROUND}, a AS (SELECT area_id, year, avg(rate) AS m FROM near GROUP BY ALL), j AS (SELECT p.area_id, p.year, p.rate AS r, a.m FROM panel_all p JOIN a ON p.area_id = a.area_id AND p.year = a.year),
w AS (SELECT year, r - avg(r) OVER (PARTITION BY area_id) AS r, m - avg(m) OVER (PARTITION BY area_id) AS m FROM j), v AS (SELECT r - avg(r) OVER (PARTITION BY year) AS r, m - avg(m) OVER (PARTITION BY year) AS m FROM w)
SELECT 'pooled' AS level, round(corr(r, m), 8) AS r FROM j UNION ALL SELECT 'two_way_within', round(corr(r, m), 8) FROM v""")
def e37(t):
    j = neighbours(t, {"m": edges.neighbour_mean("rate")}).join(t.panel_all.select("area_id", "year", "rate"), ["area_id", "year"])
    levels = correlation.pearson_levels(j, ["rate", "m"], "area_id", "year")
    return rounded(levels.where(F.col("level").isin("pooled", "two_way_within")).select("level", "r"), 8)
