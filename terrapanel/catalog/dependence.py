"""Panel time-series, dependence and spatial-autocorrelation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.catalog.base import PANEL, query, rounded
from terrapanel.catalog.spatial import PAIRS, nearby
from terrapanel.operators import paneltests as pt
from terrapanel.session import materialise

BASE = PANEL
WITH_PAIRS = f"{PANEL}, {PAIRS}"


def p(t):
    """The panel, written once: the tests read it several times."""
    return materialise(t.panel_all.select("area_id", "district_id", "region_id", "year", "y", "rate"))


@query("e23_within_autocorrelation", f"""WITH {BASE}, d AS (SELECT area_id, year, y - avg(y) OVER (PARTITION BY area_id) AS d FROM panel_all), l AS (SELECT k AS lag, d, lag(d, k::INT) OVER (PARTITION BY k, area_id ORDER BY year) AS dl FROM d, (SELECT unnest(generate_series(1, 5)) AS k))
SELECT lag, round(corr(d, dl), 8) AS within_autocorrelation FROM l WHERE dl IS NOT NULL GROUP BY lag""".replace("lag(d, k::INT) OVER (PARTITION BY k, area_id ORDER BY year) AS dl", "CASE k WHEN 1 THEN lag(d, 1) OVER w WHEN 2 THEN lag(d, 2) OVER w WHEN 3 THEN lag(d, 3) OVER w WHEN 4 THEN lag(d, 4) OVER w ELSE lag(d, 5) OVER w END AS dl").replace(
    "(SELECT unnest(generate_series(1, 5)) AS k))", "(SELECT unnest(generate_series(1, 5)) AS k) WINDOW w AS (PARTITION BY k, area_id ORDER BY year))"))
def e23(t):
    return rounded(pt.within_autocorrelation(p(t), "area_id", "year", "y", 5), 8)


@query("e27_time_factor_shares")
def e27(t):
    d = p(t)
    a = pt.time_factors(d, "area_id", "year", "y", False)[0].withColumn("preprocessing", F.lit("entity"))
    b = pt.time_factors(d, "area_id", "year", "y", True)[0].withColumn("preprocessing", F.lit("entity_and_period"))
    return a.unionByName(b)


@query("e27_time_factor_paths")
def e27p(t):
    return pt.time_factors(p(t), "area_id", "year", "y", False)[1]


@query("e27_factor_scores_vs_attributes")
def e27s(t):
    from terrapanel.operators.correlation import cross_moments
    s = pt.time_factors(p(t), "area_id", "year", "y", True)[2].join(t.areas, "area_id")
    return cross_moments(s, ["f1", "f2", "f3", "income"]).where("b = 'income'")


@query("e28_factor_criteria", f"""WITH {BASE}, d AS (SELECT y - avg(y) OVER (PARTITION BY area_id) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS d FROM panel_all) SELECT round(avg(d * d), 12) AS v, round(ln(avg(d * d)), 8) AS ic_p1 FROM d""")
def e28(t):
    return pt.factor_criteria(p(t), "area_id", "year", "y", 3).where("k_factors = 0").select(F.round("v", 12).alias("v"), F.round("ic_p1", 8).alias("ic_p1"))


@query("e28_factor_criteria_all")
def e28b(t):
    return pt.factor_criteria(p(t), "area_id", "year", "y")


HT = f"""WITH {BASE}, l AS (SELECT area_id, year, V AS y, lag(V) OVER (PARTITION BY area_id ORDER BY year) AS l FROM src), d AS (SELECT area_id, y - avg(y) OVER (PARTITION BY area_id) AS yd, l - avg(l) OVER (PARTITION BY area_id) AS ld FROM l WHERE l IS NOT NULL),
r AS (SELECT sum(yd * ld) / sum(ld * ld) AS rho, count(DISTINCT area_id) AS n, 6.0::DOUBLE AS t FROM d)
SELECT round(rho, 9) AS rho, round(sqrt(n) * (rho - (1 - 3 / (t + 1))) / sqrt(3 * (17 * t * t - 20 * t + 17) / (5 * (t - 1) * (t + 1) ** 3)), 6) AS z, n, 6::BIGINT AS transitions FROM r"""


@query("e29_harris_tzavalis", HT.replace("FROM src", "FROM panel_all").replace("V AS y", "y AS y").replace("lag(V)", "lag(y)"))
def e29(t):
    return rounded(pt.harris_tzavalis(p(t), "area_id", "year", "y").select("rho", "z", "n", "transitions"), 9, z=6)


@query("e29_harris_tzavalis_demeaned", HT.replace("FROM src", "FROM (SELECT *, y - avg(y) OVER (PARTITION BY year) AS q FROM panel_all)").replace("V AS y", "q AS y").replace("lag(V)", "lag(q)"))
def e29d(t):
    return rounded(pt.harris_tzavalis(p(t), "area_id", "year", "y", remove_period_means=True).select("rho", "z", "n", "transitions"), 9, z=6)


@query("e29_harris_tzavalis_trend", f"""WITH {BASE}, l AS (SELECT area_id, year - 1995.0 AS t, y, lag(y) OVER (PARTITION BY area_id ORDER BY year) AS l FROM panel_all), m AS (SELECT *, avg(t) OVER w AS mt, avg(y) OVER w AS my, avg(l) OVER w AS ml, regr_slope(y, t) OVER w AS sy, regr_slope(l, t) OVER w AS sl FROM l WHERE l IS NOT NULL WINDOW w AS (PARTITION BY area_id)),
d AS (SELECT y - my - sy * (t - mt) AS yd, l - ml - sl * (t - mt) AS ld FROM m) SELECT round(sum(yd * ld) / sum(ld * ld), 8) AS rho FROM d""")
def e29t(t):
    return rounded(pt.harris_tzavalis(p(t), "area_id", "year", "y", trend=True).select("rho"), 8)


@query("e30_hadri", f"""WITH {BASE}, e AS (SELECT area_id, year, y - avg(y) OVER (PARTITION BY area_id) AS e FROM panel_all), s AS (SELECT area_id, e, sum(e) OVER (PARTITION BY area_id ORDER BY year ROWS UNBOUNDED PRECEDING) AS s FROM e),
u AS (SELECT sum(s * s) / (7.0 * sum(e * e)) AS lm FROM s GROUP BY area_id) SELECT round(avg(lm), 9) AS lm, count(*) AS n, 7::BIGINT AS t FROM u""")
def e30(t):
    return rounded(pt.hadri(p(t), "area_id", "year", "y").select("lm", "n", "t"), 9)


@query("e30_hadri_test", f"""WITH {BASE}, e AS (SELECT area_id, year, y - avg(y) OVER (PARTITION BY year) AS q FROM panel_all), f AS (SELECT area_id, year, q - avg(q) OVER (PARTITION BY area_id) AS e FROM e), s AS (SELECT area_id, e, sum(e) OVER (PARTITION BY area_id ORDER BY year ROWS UNBOUNDED PRECEDING) AS s FROM f),
u AS (SELECT sum(s * s) / (7.0 * sum(e * e)) AS lm FROM s GROUP BY area_id) SELECT round(avg(lm), 9) AS lm, round(4.0::DOUBLE / 21, 9) AS null_mean, count(*) AS n, 7::BIGINT AS t FROM u""")
def e30b(t):
    return rounded(pt.hadri(p(t), "area_id", "year", "y", remove_period_means=True).drop("z", "p"), 9)


@query("e31_unit_adf", f"""WITH {BASE}, d AS (SELECT area_id, lag(y) OVER w AS l, y - lag(y) OVER w AS dy FROM panel_all WINDOW w AS (PARTITION BY area_id ORDER BY year)), u AS (SELECT area_id, regr_count(dy, l)::BIGINT AS n, regr_sxx(dy, l) AS sxx, regr_sxy(dy, l) AS sxy, regr_syy(dy, l) AS syy FROM d WHERE l IS NOT NULL GROUP BY 1)
SELECT area_id, n, round((sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) AS t FROM u""")
def e31(t):
    return rounded(pt.unit_adf(p(t), "area_id", "year", "y").select("area_id", "n", "t"), 6)


@query("e31_combined_adf", f"""WITH {BASE}, d AS (SELECT area_id, lag(y) OVER w AS l, y - lag(y) OVER w AS dy FROM panel_all WINDOW w AS (PARTITION BY area_id ORDER BY year)), u AS (SELECT area_id, regr_count(dy, l) AS n, regr_sxx(dy, l) AS sxx, regr_sxy(dy, l) AS sxy, regr_syy(dy, l) AS syy FROM d WHERE l IS NOT NULL GROUP BY 1),
t AS (SELECT (sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t FROM u), s AS (SELECT greatest(-6.361340902404056::DOUBLE, least(6.361340902404056::DOUBLE, CASE WHEN t > 2.74 THEN 99 WHEN t < -18.83 THEN -99 WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t
 ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END::DOUBLE)) AS z FROM t) SELECT count(*) AS n, 0::BIGINT AS n_excluded, round(avg((z < -1.6448536269514722)::INT), 9) AS share_reject, round(sum(z) / sqrt(count(*)), 5) AS z FROM s""")
def e31b(t):
    return rounded(pt.combined_adf(p(t), "area_id", "year", "y").drop("p"), 9, z=5)


def cd_sql(src: str) -> str:
    return f"""WITH {BASE}, q AS ({src}), e AS (SELECT area_id, year, v - avg(v) OVER (PARTITION BY area_id) AS e FROM q), s AS (SELECT area_id, year, e / sqrt(ss) AS s FROM (SELECT *, sum(e * e) OVER (PARTITION BY area_id) AS ss FROM e) WHERE ss > 1e-20), c AS (SELECT count(DISTINCT area_id) AS n, count(DISTINCT year) AS t FROM s),
q2 AS (SELECT sum(p * p) AS q FROM (SELECT sum(s) AS p FROM s GROUP BY year)) SELECT round(sqrt(2.0 * t / (n * (n - 1.0))) * (q - n) / 2, 6) AS cd, round((q - n) / (n * (n - 1.0)), 9) AS mean_corr, n, t FROM c, q2"""


@query("e32_pesaran_cd", cd_sql("SELECT area_id, year, y AS v FROM panel_all"))
def e32(t):
    return rounded(pt.pesaran_cd(p(t), "area_id", "year", "y").select("cd", "mean_corr", "n", "t"), 9, cd=6)


@query("e33_cd_after_region_year", cd_sql("SELECT area_id, year, d - avg(d) OVER (PARTITION BY region_id, year) AS v FROM (SELECT *, y - avg(y) OVER (PARTITION BY area_id) AS d FROM panel_all)"))
def e33(t):
    d = pt.remove_effects(p(t), "area_id", "year", "y", "region_id")
    return rounded(pt.pesaran_cd(d, "area_id", "year", "y").select("cd", "mean_corr", "n", "t"), 9, cd=6)


def _cd_variant(label: str, group: str, least: int) -> str:
    inner = "(SELECT *, y - avg(y) OVER (PARTITION BY area_id) AS d FROM panel_all)"
    size = f"(SELECT {group} AS g, count(DISTINCT area_id) AS k FROM panel_all GROUP BY 1)" if group else "(SELECT 0 AS g, 0 AS k)"
    keys = f"{group}, year" if group else "year"
    v = f"CASE WHEN k >= {least} THEN d - avg(d) OVER (PARTITION BY {keys}) ELSE 0.0 END"
    return f"SELECT '{label}' AS label, * FROM ({cd_sql(f'SELECT area_id, year, {v} AS v FROM {inner} JOIN {size} ON {group or 0} = g')})"


@query("e33_cd_variants", " UNION ALL ".join(_cd_variant(*x) for x in (("year", "", 0), ("region_year", "region_id", 0), ("district_year", "district_id", 4))))
def e33b(t):
    d, out = p(t), None
    for label, group, least in (("year", None, 0), ("region_year", "region_id", 0), ("district_year", "district_id", 4)):
        part = pt.pesaran_cd(pt.remove_effects(d, "area_id", "year", "y", group, least), "area_id", "year", "y", label)
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("label", "cd", "mean_corr", "n", "t"), 9, cd=6)


@query("e34_neighbour_correlation", f"""WITH {WITH_PAIRS}, e AS (SELECT area_id, year, y - avg(y) OVER (PARTITION BY area_id) AS e FROM panel_all), s AS (SELECT area_id, year, e / sqrt(sum(e * e) OVER (PARTITION BY area_id)) AS s FROM e),
r AS (SELECT src, dst, sum(a.s * b.s) AS r FROM pairs JOIN s a ON src = a.area_id JOIN s b ON dst = b.area_id AND a.year = b.year WHERE src < dst GROUP BY ALL) SELECT count(*) AS n_pairs, round(avg(r), 9) AS mean_corr FROM r""")
def e34(t):
    return rounded(pt.neighbour_correlation(p(t), nearby(t), "area_id", "year", "y"), 9)


MORAN = f"""WITH {WITH_PAIRS}, z AS (SELECT area_id, year, y - avg(y) OVER (PARTITION BY year) AS z FROM panel_all), l AS (SELECT src AS area_id, year, avg(z) AS wz FROM pairs JOIN z ON dst = area_id GROUP BY ALL), j AS (SELECT z.*, wz FROM z LEFT JOIN l ON z.area_id = l.area_id AND z.year = l.year)"""


@query("e35_morans_i", MORAN + " SELECT year, count(*) AS n, round(count(z) / count(wz) * sum(z * wz) / sum(z * z), 9) AS morans_i FROM j GROUP BY year")
def e35(t):
    return rounded(pt.morans_i(p(t), nearby(t), "area_id", "y", ["year"]), 9)


ORDERS = MORAN + """, n AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY area_id) AS i FROM j),
x0 AS (SELECT n.*, rep, (i * 48271 + rep * 69621 + 7 * 16807) % 2147483647 AS x FROM n, (SELECT unnest(range(1, 1000)) AS rep)), x1 AS (SELECT * REPLACE ((x * x + i) % 2147483647 AS x) FROM x0),
x2 AS (SELECT * REPLACE ((x * x + rep) % 2147483647 AS x) FROM x1), x3 AS (SELECT * REPLACE ((x * x + i * 31) % 2147483647 AS x) FROM x2),
o AS (SELECT year, rep, i, z, row_number() OVER (PARTITION BY year, rep ORDER BY x, i) AS slot FROM x3)"""


@query("e35_moran_permutation", ORDERS + """, m AS (SELECT o.year, o.rep, n.area_id, o.z FROM o JOIN n ON o.year = n.year AND o.slot = n.i),
w AS (SELECT src AS area_id, year, rep, avg(z) AS wz FROM pairs JOIN m ON dst = area_id GROUP BY ALL),
s AS (SELECT m.year, m.rep, count(*) / count(wz) * sum(z * wz) / sum(z * z) AS i FROM m LEFT JOIN w ON m.area_id = w.area_id AND m.year = w.year AND m.rep = w.rep GROUP BY ALL),
a AS (SELECT year, count(*) AS n, count(z) / count(wz) * sum(z * wz) / sum(z * z) AS morans_i FROM j GROUP BY year),
c AS (SELECT a.year, any_value(n) AS n, any_value(morans_i) AS morans_i, count(*) FILTER (WHERE i >= morans_i - 1e-9 * abs(morans_i)) AS larger, avg(i) AS m, stddev_pop(i) AS sd FROM a JOIN s ON a.year = s.year GROUP BY a.year)
SELECT year, n, round(morans_i, 9) AS morans_i, round((morans_i - m) / sd, 7) AS z_sim, round((least(larger, 999 - larger) + 1) / 1000.0::DOUBLE, 9) AS p_sim FROM c""")
def e35b(t):
    return rounded(pt.moran_permutation(p(t), nearby(t), "area_id", "y", ["year"]), 9, z_sim=7)


@query("e36_local_moran", MORAN + """ SELECT area_id, year, round((n - 1) * z * wz / ss, 8) AS local_i, CAST(CASE WHEN z > 0 AND wz > 0 THEN 1 WHEN z <= 0 AND wz > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS BIGINT) AS quadrant
 FROM (SELECT *, sum(z * z) OVER (PARTITION BY year) AS ss, count(*) OVER (PARTITION BY year) AS n FROM j) WHERE wz IS NOT NULL""")
def e36(t):
    l = pt.local_moran(p(t), nearby(t), "area_id", "y", ["year"])
    return rounded(l.where("wz IS NOT NULL").select("area_id", "year", "local_i", "quadrant"), 8)


@query("e36_local_moran_clusters", ORDERS + """, d AS (SELECT src AS area_id, year, count(*) AS degree FROM pairs JOIN z ON dst = area_id GROUP BY ALL),
u AS (SELECT year, rep, slot, sum(z) OVER (PARTITION BY year, rep ORDER BY slot ROWS UNBOUNDED PRECEDING) AS run FROM o WHERE slot <= (SELECT max(degree) + 1 FROM d)),
g AS (SELECT n.area_id, n.year, n.z, n.wz, degree, count(*) FILTER (WHERE n.z * (CASE WHEN o.slot <= degree THEN b.run - n.z ELSE a.run END) / degree >= n.z * n.wz - 1e-9 * abs(n.z * n.wz)) AS larger
 FROM n JOIN d ON n.area_id = d.area_id AND n.year = d.year JOIN o ON o.year = n.year AND o.i = n.i JOIN u a ON a.year = n.year AND a.rep = o.rep AND a.slot = degree JOIN u b ON b.year = n.year AND b.rep = o.rep AND b.slot = degree + 1 GROUP BY ALL),
t AS (SELECT n.year, n.z, n.wz, (least(larger, 999 - larger) + 1) / 1000.0::DOUBLE AS p FROM n LEFT JOIN g ON n.area_id = g.area_id AND n.year = g.year)
SELECT year, CASE WHEN p IS NULL OR p >= 0.05 THEN 'not significant' WHEN z > 0 AND wz > 0 THEN 'High-High' WHEN z <= 0 AND wz > 0 THEN 'Low-High' WHEN z <= 0 THEN 'Low-Low' ELSE 'High-Low' END AS cluster_type, count(*) AS n FROM t GROUP BY ALL""")
def e36b(t):
    return pt.cluster_types(pt.local_moran_permutation(p(t), nearby(t), "area_id", "y", ["year"]), by=["year"])
