"""Within transforms, fixed-effects regression and its specification checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.catalog.base import PANEL, POINTS, query, rounded
from terrapanel.catalog.spatial import PAIRS
from terrapanel.functions.expressions import percent_effect
from terrapanel.operators import clean, grid, profile
from terrapanel.operators import regression as reg
from terrapanel.operators import within as wt
from terrapanel.operators.indexing import add_zscores
from terrapanel.operators.quantiles import quantile_bins
from terrapanel.operators.specgrid import every_subset, fit_blocks, specification_grid
from terrapanel.session import materialise

SAMPLE = f"""{PANEL}, d AS (SELECT * FROM panel WHERE district_id IN (SELECT district_id FROM panel GROUP BY 1 HAVING count(DISTINCT area_id) >= 2)),
w1 AS (SELECT *, x - avg(x) OVER (PARTITION BY area_id) AS xa, y - avg(y) OVER (PARTITION BY area_id) AS ya FROM d),
w AS (SELECT *, xa - avg(xa) OVER (PARTITION BY year) AS xd, ya - avg(ya) OVER (PARTITION BY year) AS yd FROM w1),
v AS (SELECT *, xa - avg(xa) OVER (PARTITION BY district_id, year) AS xd, ya - avg(ya) OVER (PARTITION BY district_id, year) AS yd FROM w1)"""
A, Y, DY, RY = ["area_id"], ["year"], ["district_id", "year"], ["region_id", "year"]


def sample(t):
    """The estimation panel, written once: a fit reads it several times."""
    return materialise(clean.groups_with_two(t.panel, "district_id", "area_id"))


@query("w16_group_demean", f"WITH {PANEL} SELECT area_id, year, round(y - avg(y) OVER (PARTITION BY area_id), 9) AS y FROM panel")
def w16(t):
    return rounded(wt.demean(t.panel, ["y"], A).select("area_id", "year", "y"), 9)


@query("w17_two_way_demean", f"WITH {SAMPLE} SELECT area_id, year, round(xd, 7) AS x, round(yd, 9) AS y FROM w")
def w17(t):
    return rounded(wt.demean(sample(t), ["x", "y"], A, Y).select("area_id", "year", "x", "y"), 7, y=9)


@query("w17_unbalanced_within", f"WITH {SAMPLE} SELECT year, count(*) AS n, true AS x_centred, true AS y_centred FROM d WHERE (area_id * 7 + year) % 5 <> 0 GROUP BY year")
def w17u(t):
    holes = sample(t).where("(area_id * 7 + year) % 5 <> 0").select("area_id", "year", "x", "y")
    done = wt.within_transform(holes, ["x", "y"], [A, Y])
    return done.groupBy("year").agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("x")) < 1e-6).alias("x_centred"), (F.abs(F.avg("y")) < 1e-6).alias("y_centred"))


def fe_sql(src: str, k: str, cluster: str = "district_id") -> str:
    return f"""WITH {SAMPLE}, b AS (SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx, count(*) AS n, 1 - sum((yd - xd * (SELECT sum(xd * yd) / sum(xd * xd) FROM {src})) ** 2) / sum(yd * yd) AS r2 FROM {src}),
s AS (SELECT {cluster} AS g, sum(xd * (yd - b * xd)) AS s FROM {src}, b GROUP BY 1), m AS (SELECT sum(s * s) AS m, count(*) AS g FROM s)
SELECT 'x' AS term, round(b, 11) AS coef, round(sqrt(m.m) / sxx * sqrt(m.g / (m.g - 1.0) * (n - 1.0) / (n - {k})), 11) AS se, n AS n_obs, m.g AS n_clusters, round(r2, 9) AS r2_within FROM b, m"""


def short(f, spec=""):
    return rounded(f.table(spec).select("term", "coef", "se", "n_obs", "n_clusters", "r2_within"), 11, r2_within=9)


@query("e01_fe_entity_year", fe_sql("w", "(1 + 1 + 5)"))
def e01(t):
    return short(reg.fit(sample(t), "y", ["x"], [A, Y], [["district_id"]]))


@query("e01_fe_entity_district_year", fe_sql("v", "2"))
def e01b(t):
    return short(reg.fit(sample(t), "y", ["x"], [A, DY], [["district_id"]]))


@query("e02_weighted_fe", f"""WITH {PANEL}, d AS (SELECT *, y - sum(n * y) OVER (PARTITION BY area_id) / sum(n) OVER (PARTITION BY area_id) AS yd, x - sum(n * x) OVER (PARTITION BY area_id) / sum(n) OVER (PARTITION BY area_id) AS xd FROM panel),
b AS (SELECT sum(n * xd * yd) / sum(n * xd * xd) AS b, sum(n * xd * xd) AS sxx, count(*) AS size FROM d), s AS (SELECT area_id, sum(n * xd * (yd - b * xd)) AS s FROM d, b GROUP BY 1)
SELECT 'x' AS term, round(any_value(b), 11) AS coef, round(sqrt(sum(s * s)) / any_value(sxx) * sqrt(count(*) / (count(*) - 1.0) * (any_value(size) - 1.0) / (any_value(size) - 2.0)), 11) AS se, any_value(size)::BIGINT AS n_obs FROM s, b""")
def e02(t):
    f = reg.fit(t.panel, "y", ["x"], [A], [["area_id"]], weight="n")
    return rounded(f.table().select("term", "coef", "se", "n_obs"), 11)


@query("e03_entity_cluster", fe_sql("w", "(1 + 1 + 5)", "area_id"))
def e03(t):
    return short(reg.fit(sample(t), "y", ["x"], [A, Y], [["area_id"]]))


@query("e03_iid_and_hc1", f"""WITH {SAMPLE}, b AS (SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx, count(*) AS n, count(DISTINCT area_id) + 6 - 1 + 1 AS k FROM w),
r AS (SELECT sum((yd - b * xd) ** 2) AS rss, sum((xd * (yd - b * xd)) ** 2) AS meat FROM w, b)
SELECT 'iid' AS spec, round(sqrt(rss / (n - k) / sxx), 11) AS se FROM b, r UNION ALL SELECT 'hc1', round(sqrt(meat * n / (n - k)) / sxx, 11) FROM b, r""")
def e03b(t):
    d = sample(t)
    prepared = reg.prepare(d, ["y", "x"], [A, Y], [])
    a, b = (reg.fit(d, "y", ["x"], [A, Y], c, prepared=prepared).table(c) for c in ("iid", "hc1"))
    return rounded(a.unionByName(b).select("spec", "se"), 11)


@query("e03_two_way_cluster", f"""WITH {SAMPLE}, b AS (SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx, count(*) AS n FROM w),
u AS (SELECT district_id, year, xd * (yd - b * xd) AS s FROM w, b), m1 AS (SELECT sum(s * s) AS m, count(*) AS g FROM (SELECT sum(s) AS s FROM u GROUP BY district_id)), m2 AS (SELECT sum(s * s) AS m, count(*) AS g FROM (SELECT sum(s) AS s FROM u GROUP BY year)),
m12 AS (SELECT sum(s * s) AS m FROM (SELECT sum(s) AS s FROM u GROUP BY district_id, year))
SELECT 'x' AS term, least(m1.g, m2.g) AS n_clusters, round(sqrt((m1.m + m2.m - m12.m) * least(m1.g, m2.g) / (least(m1.g, m2.g) - 1.0) * (n - 1.0) / (n - 2.0)) / sxx, 11) AS se FROM b, m1, m2, m12""")
def e03c(t):
    f = reg.fit(sample(t), "y", ["x"], [A, Y], [["district_id"], ["year"]])
    return rounded(f.table().select("term", "n_clusters", "se"), 11)


@query("e04_effect_scaling", f"WITH {SAMPLE}, b AS (SELECT sum(xd * yd) / sum(xd * xd) AS b FROM w), s AS (SELECT stddev_samp(x) AS s FROM d) SELECT round(100 * (exp(b) - 1), 8) AS per_unit, round(100 * (exp(b * s) - 1), 6) AS per_sd FROM b, s")
def e04(t):
    d = sample(t)
    f = reg.fit(d, "y", ["x"], [A, Y], "iid")
    b = F.lit(float(f.beta[0]))
    return rounded(d.agg(F.stddev_samp("x").alias("s")).select(percent_effect(b).alias("per_unit"), percent_effect(b, F.col("s")).alias("per_sd")), 8, per_sd=6)


@query("e06_nested_f", f"""WITH {SAMPLE}, ra AS (SELECT sum(ya * ya) - sum(xa * ya) ** 2 / sum(xa * xa) AS s, count(*) AS n, count(DISTINCT area_id) AS k FROM w), rb AS (SELECT sum(yd * yd) - sum(xd * yd) ** 2 / sum(xd * xd) AS s FROM w)
SELECT round(((ra.s - rb.s) / 5) / (rb.s / (n - (k + 6))), 7) AS F, 5::BIGINT AS df1, n - (k + 6) AS df2 FROM ra, rb""")
def e06(t):
    d = sample(t)
    one, two = reg.fit(d, "y", ["x"], [A]), reg.fit(d, "y", ["x"], [A, Y])
    f = reg.nested_f(one, two, 5, two.n_params)
    return rounded(t.spark.createDataFrame([(f["F"], f["df1"], f["df2"])], "F double, df1 long, df2 long"), 7)


@query("e09_holm", f"""WITH {PANEL}, p AS (SELECT region_id, year, 1 / (1 + avg(rate)) AS p FROM panel_all GROUP BY ALL), s AS (SELECT *, (count(*) OVER (PARTITION BY region_id) - row_number() OVER (PARTITION BY region_id ORDER BY p, year) + 1) * p AS s FROM p)
SELECT region_id, year, round(least(1.0, max(s) OVER (PARTITION BY region_id ORDER BY p, year ROWS UNBOUNDED PRECEDING)), 10) AS p_holm FROM s""")
def e09(t):
    p = t.panel_all.groupBy("region_id", "year").agg((1 / (1 + F.avg("rate"))).alias("p"))
    return rounded(reg.holm(p, "region_id", "p", ["year"]).select("region_id", "year", "p_holm"), 10)


@query("e10_specification_sweep", f"""WITH {SAMPLE.replace("x - avg(x) OVER (PARTITION BY area_id) AS xa,", "x - avg(x) OVER (PARTITION BY area_id) AS xa, x * n - avg(x * n) OVER (PARTITION BY area_id) AS za,")},
z AS (SELECT *, za - avg(za) OVER (PARTITION BY year) AS zd FROM w), g AS (SELECT sum(xd * xd) AS xx, sum(zd * zd) AS zz, sum(xd * zd) AS xz, sum(xd * yd) AS xy, sum(zd * yd) AS zy FROM z)
SELECT 'alone' AS spec, 'x' AS term, round(xy / xx, 11) AS coef FROM g UNION ALL SELECT 'joint', 'x', round((xy * zz - zy * xz) / (xx * zz - xz * xz), 11) FROM g UNION ALL SELECT 'joint', 'x_n', round((zy * xx - xy * xz) / (xx * zz - xz * xz), 12) FROM g""")
def e10(t):
    d = sample(t).withColumn("x_n", F.col("x") * F.col("n"))
    out = reg.sweep(d, "y", {"alone": ["x"], "joint": ["x", "x_n"]}, [A, Y], ["district_id"])
    return out.select("spec", "term", F.when(F.col("term") == "x_n", F.round("coef", 12)).otherwise(F.round("coef", 11)).alias("coef"))


GRID_YEARS, GRID_REFERENCE = list(range(1996, 2002)), 1998
MODERATORS = ["income_z", "east_z", "north_z", "trade_z"]
GRID_FES = {"entity_year": [A, Y], "entity_district_year": [A, DY]}


def fits_sql(heads: str, samples: dict[str, tuple[str, dict[str, str]]], specs: list[tuple[str, str, str, str, list[str], int]], result: str) -> str:
    """Least squares with absorbed effects over balanced samples, in long form: Gram matrices by cluster, Gauss-Jordan elimination of every specification at once, cluster-robust
    covariance of its first terms.

    ``samples``: name -> (rows with area_id, district_id, year; columns as expressions). ``specs``: (name, sample, structure, outcome, regressors, number of first terms). ``result`` selects
    from iv (spec, k, m = [I | coefficients | inverse], cols), vs (spec, a, b, v: covariances of the first terms by number), size (sample, n, g) and we (joint tests of the terms after the first).
    """
    long = " UNION ALL ".join(f"""SELECT '{name}' AS sample, area_id, district_id, year, unnest([{', '.join(f"{{'c': '{c}', 'v': CAST({e} AS DOUBLE)}}" for c, e in columns.items())}], recursive := true) FROM ({source})"""
                              for name, (source, columns) in samples.items())
    listed = ", ".join(f"('{spec}', '{sample}', '{structure}', '{y}', {cols}, {terms})" for spec, sample, structure, y, cols, terms in specs)
    eliminate = "list_transform(m, lambda r, i: CASE WHEN i = p + 1 THEN list_transform(r, lambda v: v / r[p + 1]) ELSE list_transform(r, lambda v, j: v - r[p + 1] * m[p + 1][j] / m[p + 1][p + 1]) END)"
    return f"""WITH RECURSIVE {heads}, l0 AS ({long}),
l1 AS (SELECT * REPLACE (v - avg(v) OVER (PARTITION BY sample, area_id, c) AS v) FROM l0),
l2 AS (SELECT 'entity' AS structure, * FROM l1 UNION ALL SELECT 'entity_year' AS structure, * REPLACE (v - avg(v) OVER (PARTITION BY sample, year, c) AS v) FROM l1 UNION ALL SELECT 'entity_district_year', * REPLACE (v - avg(v) OVER (PARTITION BY sample, district_id, year, c) AS v) FROM l1),
gc AS (SELECT a.sample, a.structure, a.district_id, a.c AS i, b.c AS j, sum(a.v * b.v) AS g FROM l2 a JOIN l2 b ON a.sample = b.sample AND a.structure = b.structure AND a.area_id = b.area_id AND a.year = b.year GROUP BY ALL),
gt AS (SELECT sample, structure, i, j, sum(g) AS g FROM gc GROUP BY ALL),
sp(spec, sample, structure, y, cols, n_terms) AS (VALUES {listed}),
m1 AS (SELECT spec, list_position(cols, i) AS i, list(g ORDER BY list_position(list_append(cols, y), j)) AS r FROM sp JOIN gt ON sp.sample = gt.sample AND sp.structure = gt.structure AND list_contains(cols, i) AND list_contains(list_append(cols, y), j) GROUP BY ALL),
m2 AS (SELECT spec, count(*)::BIGINT AS k, list(r ORDER BY i) AS m FROM m1 GROUP BY 1),
e(spec, k, p, m) AS (SELECT spec, k, 0::BIGINT, list_transform(m, lambda r, i: list_concat(r, list_transform(range(1, k + 1), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) FROM m2
 UNION ALL SELECT spec, k, p + 1, {eliminate} FROM e WHERE p < k),
iv AS (SELECT e.*, sp.sample, structure, y, cols, n_terms FROM e JOIN sp ON e.spec = sp.spec WHERE p = k),
sc AS (SELECT spec, district_id, list_position(any_value(cols), i) AS i, sum(g * CASE WHEN j = y THEN 1.0::DOUBLE ELSE -m[list_position(cols, j)][k + 1] END) AS s
 FROM iv JOIN gc ON iv.sample = gc.sample AND iv.structure = gc.structure AND list_contains(cols, i) AND list_contains(list_append(cols, y), j) GROUP BY spec, district_id, gc.i),
u AS (SELECT iv.spec, sc.district_id, t.t, sum(m[t.t][k + 1 + sc.i] * s) AS u FROM iv JOIN sc ON iv.spec = sc.spec, LATERAL (SELECT unnest(range(1, n_terms + 1)) AS t) t GROUP BY ALL),
size AS (SELECT sample, count(DISTINCT (area_id, year)) AS n, count(DISTINCT district_id) AS g, count(DISTINCT year) AS years FROM l0 GROUP BY 1),
vc AS (SELECT a.spec, a.t AS a, b.t AS b, sum(a.u * b.u) AS v FROM u a JOIN u b ON a.spec = b.spec AND a.district_id = b.district_id GROUP BY ALL),
vs AS (SELECT vc.spec, a, b, v * g / (g - 1.0) * (n - 1.0) / (n - (k + CASE WHEN structure = 'entity_year' THEN years ELSE 1 END)) AS v FROM vc JOIN iv ON vc.spec = iv.spec JOIN size ON iv.sample = size.sample),
wm AS (SELECT vs.spec, a, list_append(list(v ORDER BY b), any_value(m[a][k + 1])) AS r FROM vs JOIN iv ON vs.spec = iv.spec WHERE a > 1 AND b > 1 GROUP BY ALL),
we(spec, k, p, m) AS (SELECT spec, count(*)::BIGINT, 0::BIGINT, list(r ORDER BY a) FROM wm GROUP BY 1 UNION ALL SELECT spec, k, p + 1, {eliminate} FROM we WHERE p < k),
wald AS (SELECT we.spec, we.k AS q, list_sum(list_transform(we.m, lambda r, i: r[we.k + 1] * iv.m[i + 1][iv.k + 1])) AS w FROM we JOIN iv ON we.spec = iv.spec WHERE we.p = we.k)
{result}"""


#: Coefficients of every specification's first terms.
TERMS_OF_FITS = """SELECT iv.spec, iv.cols[a] AS term, round(iv.m[a][iv.k + 1], 10) AS coef, round(sqrt(v), 10) AS se, round(iv.m[a][iv.k + 1] / sqrt(v), 7) AS t, n AS n_obs, g AS n_clusters
 FROM vs JOIN iv ON vs.spec = iv.spec JOIN size ON iv.sample = size.sample WHERE a = b"""


def terms_of(table):
    return rounded(table.select("spec", "term", "coef", "se", "t", "n_obs", "n_clusters"), 10, t=7)


def grid_sql(result: str) -> str:
    names = {m: f"x_{m}" for m in MODERATORS}
    controls = {m: [f"{m}_x_{p}" for p in GRID_YEARS if p != GRID_REFERENCE] for m in MODERATORS}
    cells = {"y": "y", "x": "x", **{names[m]: f"x * {m}" for m in MODERATORS}, **{f"{m}_x_{p}": f"CASE WHEN year = {p} THEN {m} ELSE 0 END" for m in MODERATORS for p in GRID_YEARS if p != GRID_REFERENCE}}
    specs, labels = [], []
    for structure in GRID_FES:
        for c in (False, True):
            for s, mods in every_subset(MODERATORS).items():
                spec = f"{structure}_{'periods' if c else 'plain'}_{s}"
                specs.append((spec, "d", structure, "y", ["x", *[names[m] for m in mods], *([z for m in mods for z in controls[m]] if c else [])], 1 + len(mods)))
                labels.append(f"('{spec}', {str(c).lower()}, '{s}', {len(mods)}::BIGINT)")
    heads = f"""{SAMPLE}, {POINTS}, zt AS (SELECT a.area_id, (income - avg(income) OVER ()) / stddev_samp(income) OVER () AS income_z, (px - avg(px) OVER ()) / stddev_samp(px) OVER () AS east_z,
 (py - avg(py) OVER ()) / stddev_samp(py) OVER () AS north_z, (base - avg(base) OVER ()) / stddev_samp(base) OVER () AS trade_z FROM areas a JOIN points p ON a.area_id = p.area_id JOIN baseline b ON a.area_id = b.area_id),
label(spec, controls, set_name, n_moderators) AS (VALUES {', '.join(labels)})"""
    return fits_sql(heads, {"d": ("SELECT d.*, income_z, east_z, north_z, trade_z FROM d JOIN zt ON d.area_id = zt.area_id", cells)}, specs, result)


def grid_results(t):
    z = t.areas.join(t.points, "area_id").join(t.baseline, "area_id")
    z = add_zscores(z, {"income": "income_z", "px": "east_z", "py": "north_z", "base": "trade_z"}).select("area_id", *MODERATORS)
    d = materialise(sample(t).join(z, "area_id"))
    return specification_grid(d, "y", "x", MODERATORS, every_subset(MODERATORS), GRID_FES, ["district_id"], "year", GRID_YEARS, GRID_REFERENCE)


@query("e10_specification_grid", grid_sql("""SELECT vs.spec, iv.structure, controls, set_name AS "set", n_moderators, iv.cols[a] AS term, round(iv.m[a][iv.k + 1], 10) AS coef, round(sqrt(v), 10) AS se, n AS n_obs, g AS n_clusters
 FROM vs JOIN iv ON vs.spec = iv.spec JOIN label ON vs.spec = label.spec, size WHERE a = b"""))
def e10g(t):
    terms, _, _ = grid_results(t)
    return rounded(terms.select("spec", "structure", "controls", "set", "n_moderators", "term", "coef", "se", "n_obs", "n_clusters"), 10)


@query("e10_joint_tests", grid_sql("SELECT spec, q, round(w, 6) AS wald_chi2, round(w / q, 6) AS F FROM wald"))
def e10j(t):
    _, joint, _ = grid_results(t)
    return rounded(joint.select("spec", "q", "wald_chi2", "F"), 6)


@query("e10_marginal_effects", grid_sql("""SELECT iv.spec, z.z, round(iv.m[1][iv.k + 1] + z.z * iv.m[2][iv.k + 1], 10) AS estimate, round(sqrt(xx.v + 2 * z.z * xm.v + z.z * z.z * mm.v), 10) AS se
 FROM iv JOIN vs xx ON iv.spec = xx.spec AND xx.a = 1 AND xx.b = 1 JOIN vs xm ON iv.spec = xm.spec AND xm.a = 1 AND xm.b = 2 JOIN vs mm ON iv.spec = mm.spec AND mm.a = 2 AND mm.b = 2,
 (VALUES (-1.0::DOUBLE), (0.0::DOUBLE), (1.0::DOUBLE)) z(z) WHERE iv.n_terms = 2"""))
def e10m(t):
    _, _, marginal = grid_results(t)
    return rounded(marginal.select("spec", "z", "estimate", "se"), 10)


LADDER = {"M0_none": [], "M1_year": [Y], "M2_entity": [A], "M3_entity_year": [A, Y], "M4_district_year_additive": [["district_id"], Y], "M5_entity_region_year": [A, RY], "M6_entity_district_year": [A, DY]}


def ladder_sql() -> str:
    """Coefficient and clustered SE of each structure from demeaned columns; k counts the parameters that the clustering does not nest."""
    years, cells, districts, region_years = "(SELECT count(DISTINCT year) FROM d)", "(SELECT count(*) FROM (SELECT DISTINCT district_id, year FROM d))", "(SELECT count(DISTINCT district_id) FROM d)", "(SELECT count(*) FROM (SELECT DISTINCT region_id, year FROM d))"
    sources = {"M0_none": ("s0", "2", "2"), "M1_year": ("s1", f"1 + {years}", f"1 + {years}"), "M2_entity": ("s2", "2", "2"), "M3_entity_year": ("w", f"1 + {years}", f"1 + {years}"),
               "M4_district_year_additive": ("s4", f"1 + {years}", f"{districts} + {years}"), "M5_entity_region_year": ("s5", f"1 + {region_years}", f"1 + {region_years}"), "M6_entity_district_year": ("v", "2", f"1 + {cells}")}
    parts = []
    for spec, (src, by_district, by_area) in sources.items():
        for name, cluster, k in (("district", "district_id", by_district), ("area", "area_id", by_area)):
            parts.append(f"""SELECT '{spec}_{name}' AS spec, 'x' AS term, round(b, 11) AS coef, round(sqrt(sum(s * s)) / any_value(sxx) * sqrt(count(*) / (count(*) - 1.0) * (any_value(size) - 1.0) / (any_value(size) - ({k}))), 11) AS se,
 any_value(size)::BIGINT AS n_obs, count(*) AS n_clusters FROM (SELECT {cluster}, any_value(b) AS b, any_value(sxx) AS sxx, any_value(size) AS size, sum(xd * (yd - b * xd)) AS s FROM {src},
 (SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx, count(*) AS size FROM {src}) GROUP BY 1) GROUP BY b""")
    return f"""WITH {SAMPLE}, s0 AS (SELECT *, x - avg(x) OVER () AS xd, y - avg(y) OVER () AS yd FROM d), s1 AS (SELECT *, x - avg(x) OVER (PARTITION BY year) AS xd, y - avg(y) OVER (PARTITION BY year) AS yd FROM d),
s2 AS (SELECT *, xa AS xd, ya AS yd FROM w1), s3 AS (SELECT *, x - avg(x) OVER (PARTITION BY district_id) AS xb, y - avg(y) OVER (PARTITION BY district_id) AS yb FROM d),
s4 AS (SELECT *, xb - avg(xb) OVER (PARTITION BY year) AS xd, yb - avg(yb) OVER (PARTITION BY year) AS yd FROM s3), s5 AS (SELECT *, xa - avg(xa) OVER (PARTITION BY region_id, year) AS xd, ya - avg(ya) OVER (PARTITION BY region_id, year) AS yd FROM w1)
""" + " UNION ALL ".join(parts)


@query("e11_fe_ladder", ladder_sql())
def e11(t):
    out = reg.ladder(sample(t), "y", ["x"], LADDER, {"district": ["district_id"], "area": ["area_id"]})
    return rounded(out.select("spec", "term", "coef", "se", "n_obs", "n_clusters"), 11)


@query("e11_ladder_slopes", f"""WITH {SAMPLE}, y1 AS (SELECT x - avg(x) OVER (PARTITION BY year) AS xd, y - avg(y) OVER (PARTITION BY year) AS yd FROM d)
SELECT 'M0_none' AS spec, round(regr_slope(y, x), 11) AS coef FROM d UNION ALL SELECT 'M1_year', round(sum(xd * yd) / sum(xd * xd), 11) FROM y1 UNION ALL SELECT 'M2_entity', round(sum(xa * ya) / sum(xa * xa), 11) FROM w1
 UNION ALL SELECT 'M3_entity_year', round(sum(xd * yd) / sum(xd * xd), 11) FROM w UNION ALL SELECT 'M6_entity_district_year', round(sum(xd * yd) / sum(xd * xd), 11) FROM v""")
def e11b(t):
    d, out = sample(t), None
    for spec in ("M0_none", "M1_year", "M2_entity", "M3_entity_year", "M6_entity_district_year"):
        part = reg.fit(d, "y", ["x"], LADDER[spec]).table(spec)
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("spec", "coef"), 11)


@query("e12_event_study", fits_sql(SAMPLE, {"d": ("SELECT * FROM d", {"y": "y", "x": "x", **{f"z_x_{p}": f"CASE WHEN year = {p} THEN income / 1000 ELSE 0 END" for p in GRID_YEARS if p != GRID_REFERENCE}})},
       [("event_study", "d", "entity_year", "y", ["x", *[f"z_x_{p}" for p in GRID_YEARS if p != GRID_REFERENCE]], len(GRID_YEARS))], TERMS_OF_FITS))
def e12(t):
    d, terms = reg.period_interactions(sample(t).withColumn("z", F.col("income") / 1000), "z", "year", GRID_YEARS, GRID_REFERENCE)
    return terms_of(reg.fit(d, "y", ["x", *terms], [A, Y], [["district_id"]]).table("event_study"))


@query("e12_event_study_joint", fits_sql(SAMPLE, {"d": ("SELECT * FROM d", {"y": "y", "x": "x", **{f"z_x_{p}": f"CASE WHEN year = {p} THEN income / 1000 ELSE 0 END" for p in GRID_YEARS if p != GRID_REFERENCE}})},
       [("event_study", "d", "entity_year", "y", ["x", *[f"z_x_{p}" for p in GRID_YEARS if p != GRID_REFERENCE]], len(GRID_YEARS))], "SELECT spec, q, round(w, 6) AS wald_chi2, round(w / q, 6) AS F FROM wald"))
def e12j(t):
    """All period effects of the moderator together: a pre-trend test where the periods come before the treatment."""
    d, terms = reg.period_interactions(sample(t).withColumn("z", F.col("income") / 1000), "z", "year", GRID_YEARS, GRID_REFERENCE)
    w = reg.fit(d, "y", ["x", *terms], [A, Y], [["district_id"]]).wald(terms)
    return rounded(t.spark.createDataFrame([("event_study", w["q"], w["wald_chi2"], w["F"])], "spec string, q long, wald_chi2 double, F double"), 6)


POST = [("d", "d", "entity_year", "y", ["x", "x_income"], 2)]


@query("e01_post_estimation", fits_sql(SAMPLE, {"d": ("SELECT * FROM d", {"y": "y", "x": "x", "x_income": "x * (income - 4500) / 3000"})}, POST, """, c AS (SELECT m[1][k + 1] AS b1, m[2][k + 1] AS b2, (SELECT v FROM vs WHERE a = 1 AND b = 1) AS v11, (SELECT v FROM vs WHERE a = 1 AND b = 2) AS v12,
 (SELECT v FROM vs WHERE a = 2 AND b = 2) AS v22 FROM iv), q AS (SELECT *, (b1 * b1 * v22 - 2 * b1 * b2 * v12 + b2 * b2 * v11) / (v11 * v22 - v12 * v12) AS w FROM c)
SELECT 'wald_chi2' AS quantity, round(w, 7) AS value FROM q UNION ALL SELECT 'wald_p', round(exp(-w / 2), 7) FROM q UNION ALL SELECT 'wald_F', round(w / 2, 7) FROM q UNION ALL SELECT 'wald_p_F', round((1 + 2 * (w / 2) / (g - 1)) ** (-(g - 1) / 2.0), 7) FROM q, size
 UNION ALL SELECT 'lincom', round(b1 + b2, 7) FROM q UNION ALL SELECT 'lincom_se', round(sqrt(v11 + 2 * v12 + v22), 7) FROM q UNION ALL SELECT 'effect_at_-1.0', round(b1 - b2, 7) FROM q UNION ALL SELECT 'effect_at_0.0', round(b1, 7) FROM q UNION ALL SELECT 'effect_at_1.0', round(b1 + b2, 7) FROM q"""))
def e01p(t):
    d = sample(t).withColumn("x_income", F.col("x") * (F.col("income") - 4500) / 3000)
    f = reg.fit(d, "y", ["x", "x_income"], [A, Y], [["district_id"]])
    w, l = f.wald(["x", "x_income"]), f.lincom({"x": 1.0, "x_income": 1.0})
    rows = [("wald_chi2", w["wald_chi2"]), ("wald_p", w["p_chi2"]), ("wald_F", w["F"]), ("wald_p_F", w["p_F"]), ("lincom", l["estimate"]), ("lincom_se", l["se"])]
    rows += [(f"effect_at_{m['z']}", m["estimate"]) for m in f.marginal_effects("x", "x_income", [-1.0, 0.0, 1.0])]
    return rounded(t.spark.createDataFrame(rows, "quantity string, value double"), 7)


@query("e12_period_columns", f"WITH {PANEL} SELECT area_id, year, CASE WHEN year = 1997 THEN income ELSE 0 END AS income_x_1997, CASE WHEN year = 1999 THEN income ELSE 0 END AS income_x_1999 FROM panel")
def e12b(t):
    d, terms = reg.period_interactions(t.panel, "income", "year", [1997, 1998, 1999], 1998)
    return d.select("area_id", "year", *terms)


@query("e13_mundlak", f"""WITH {PANEL}, m AS (SELECT year, y, x, avg(x) OVER (PARTITION BY area_id) AS mx FROM panel), c AS (SELECT x - avg(x) OVER (PARTITION BY year) AS x, mx - avg(mx) OVER (PARTITION BY year) AS m, y - avg(y) OVER (PARTITION BY year) AS y FROM m),
g AS (SELECT sum(x * x) AS xx, sum(m * m) AS mm, sum(x * m) AS xm, sum(x * y) AS xy, sum(m * y) AS my FROM c)
SELECT 'x' AS term, round((xy * mm - my * xm) / (xx * mm - xm * xm), 10) AS coef FROM g UNION ALL SELECT 'x_mean', round((my * xx - xy * xm) / (xx * mm - xm * xm), 10) FROM g""")
def e13(t):
    from terrapanel.operators.correlation import attach_group_means
    d = attach_group_means(t.panel, ["x"], A)
    return rounded(reg.fit(d, "y", ["x", "x_mean"], [Y], [["district_id"]]).table().select("term", "coef"), 10)


@query("e14_serial_correlation", f"""WITH {PANEL}, fd AS (SELECT * FROM (SELECT area_id, year, y - lag(y) OVER o AS dy, x - lag(x) OVER o AS dx FROM panel WINDOW o AS (PARTITION BY area_id ORDER BY year)) WHERE dy IS NOT NULL),
c AS (SELECT area_id, year, dy - avg(dy) OVER (PARTITION BY year) AS dy, dx - avg(dx) OVER (PARTITION BY year) AS dx FROM fd), b AS (SELECT sum(dx * dy) / sum(dx * dx) AS b FROM c),
u AS (SELECT area_id, year, dy - b * dx AS u FROM c, b), l AS (SELECT *, lag(u) OVER (PARTITION BY area_id ORDER BY year) AS ul FROM u), r AS (SELECT sum(u * ul) / sum(ul * ul) AS rho, sum(ul * ul) AS d, count(ul) AS n FROM l WHERE ul IS NOT NULL), g AS (SELECT sum(u * ul) - any_value(rho) * sum(ul * ul) AS s FROM l, r WHERE ul IS NOT NULL GROUP BY area_id)
SELECT round(any_value(rho), 9) AS rho_hat, round(sqrt(sum(s * s) * count(*) / (count(*) - 1.0)) / any_value(d), 9) AS se, round((any_value(rho) + 0.5) / (sqrt(sum(s * s) * count(*) / (count(*) - 1.0)) / any_value(d)), 6) AS t, any_value(n)::BIGINT AS n FROM g, r""")
def e14(t):
    r = reg.first_difference_serial_test(t.panel, "y", "x", "area_id", "year")
    return rounded(t.spark.createDataFrame([(r["rho_hat"], r["se"], r["t"], r["n"])], "rho_hat double, se double, t double, n long"), 9, t=6)


def m3(t, keep=("n", "area_id", "year", "district_id", "region_id")):
    return reg.fit(sample(t).withColumns({"x_raw": F.col("x"), "inv_n": 1.0 / F.col("n")}), "y", ["x"], [A, Y], [["district_id"]], keep=[*keep, "x_raw", "inv_n"])


RESID = f"""{SAMPLE}, b AS (SELECT sum(xd * yd) / sum(xd * xd) AS b FROM w), u AS (SELECT area_id, year, district_id, region_id, n, x, 1.0 / n AS inv_n, yd - b * xd AS u FROM w, b)"""


@query("e15_breusch_pagan", f"""WITH {RESID}, e AS (SELECT u * u AS e2, inv_n::DOUBLE AS i, x FROM u), c AS (SELECT corr(e2, i) AS ei, corr(e2, x) AS ex, corr(i, x) AS ix, count(*) AS n FROM e)
SELECT round(n * r2, 7) AS lm, round(exp(-n * r2 / 2), 7) AS lm_p, round((r2 / 2) / ((1 - r2) / (n - 3)), 7) AS F FROM (SELECT n, (ei * ei + ex * ex - 2 * ei * ex * ix) / (1 - ix * ix) AS r2 FROM c)""")
def e15(t):
    r = reg.breusch_pagan(m3(t).residuals("u"), "u", ["inv_n", "x_raw"])
    return rounded(t.spark.createDataFrame([(r["lm"], r["lm_p"], r["F"])], "lm double, lm_p double, F double"), 7)


BIN10 = """e AS (SELECT list_sort(list_distinct(quantile_cont(n, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS raw FROM u), bn AS (SELECT u.*, 1 + len(list_filter(raw[2:-2], lambda q: q < n)) AS bin FROM u, e)"""


@query("e16_variance_by_decile", f"WITH {RESID}, {BIN10} SELECT bin, count(*) AS n_obs, round(avg(n), 6) AS mean_n, round(avg(u * u), 10) AS variance FROM bn GROUP BY bin")
def e16(t):
    d = quantile_bins(m3(t).residuals("u"), [], "n", 10, "bin")
    return rounded(d.groupBy("bin").agg(F.count(F.lit(1)).alias("n_obs"), F.avg("n").alias("mean_n"), F.avg(F.col("u") * F.col("u")).alias("variance")), 10, mean_n=6)


@query("e16_variance_on_inverse_count", f"WITH {RESID} SELECT count(*) AS n, round(regr_slope(u * u, inv_n), 8) AS slope, round(regr_intercept(u * u, inv_n), 9) AS intercept, round(corr(u * u, inv_n), 8) AS r FROM u")
def e16b(t):
    from terrapanel.operators.correlation import simple_regression
    return rounded(simple_regression(m3(t).residuals("u").withColumn("e2", F.col("u") * F.col("u")), "e2", "inv_n"), 8, intercept=9)


@query("e17_variance_in_group_means", f"""WITH {RESID}, t AS (SELECT sum(u * u) AS t FROM u) SELECT 'district' AS grouping, round(sum(n * m * m) / max(t), 9) AS share FROM (SELECT avg(u) AS m, count(*) AS n FROM u GROUP BY district_id), t
 UNION ALL SELECT 'district_year', round(sum(n * m * m) / max(t), 9) FROM (SELECT avg(u) AS m, count(*) AS n FROM u GROUP BY district_id, year), t UNION ALL SELECT 'region_year', round(sum(n * m * m) / max(t), 9) FROM (SELECT avg(u) AS m, count(*) AS n FROM u GROUP BY region_id, year), t""")
def e17(t):
    return rounded(wt.share_of_variance_in_means(m3(t).residuals("u"), "u", {"district": ["district_id"], "district_year": DY, "region_year": RY}), 9)


@query("e18_within_variance_share", f"WITH {PANEL}, a AS (SELECT district_id, year, y - avg(y) OVER (PARTITION BY area_id) AS d FROM panel), b AS (SELECT d, d - avg(d) OVER (PARTITION BY district_id, year) AS r FROM a) SELECT round(1 - sum(r * r) / sum(d * d), 9) AS share FROM b")
def e18(t):
    return rounded(wt.within_variance_share(t.panel, "y", "area_id", "district_id", "year"), 9)


SIGNS = """x0 AS (SELECT district_id, i, rep, (i * 48271 + rep * 69621 + 123 * 16807) % 2147483647 AS x FROM (SELECT district_id, row_number() OVER (ORDER BY district_id) AS i FROM (SELECT DISTINCT district_id FROM d)), (SELECT unnest(range(0, 999)) AS rep)),
x1 AS (SELECT * REPLACE ((x * x + i) % 2147483647 AS x) FROM x0), x2 AS (SELECT * REPLACE ((x * x + rep) % 2147483647 AS x) FROM x1), x3 AS (SELECT * REPLACE ((x * x + i * 31) % 2147483647 AS x) FROM x2),
signs AS (SELECT district_id, rep, CASE WHEN x % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS w FROM x3)"""


def bootstrap_sql(source: str, label: str, centred: bool) -> str:
    """Row-level bootstrap of the demeaned columns xd and yd of ``source``: signs by district, period means taken out again where ``centred``."""
    ys = "w * yd - avg(w * yd) OVER (PARTITION BY rep, year)" if centred else "w * yd"
    return f"""SELECT round(any_value(b0), 12) AS coef, round(any_value(t0), 7) AS t_raw, any_value(g)::BIGINT AS n_clusters, round(count(*) FILTER (WHERE abs(t) >= abs(t0)) / 999.0::DOUBLE, 9) AS p_wild, count(*) AS reps, '{label}' AS model FROM (
 SELECT rep, any_value(b) * any_value(sxx) / sqrt(sum(s * s)) AS t FROM (SELECT rep, district_id, any_value(b) AS b, any_value(sxx) AS sxx, sum(xd * (ys - b * xd)) AS s FROM (
  SELECT *, sum(xd * ys) OVER (PARTITION BY rep) / sum(xd * xd) OVER (PARTITION BY rep) AS b, sum(xd * xd) OVER (PARTITION BY rep) AS sxx FROM (SELECT rep, c.district_id, year, xd, {ys} AS ys FROM {source} c JOIN signs ON c.district_id = signs.district_id)) GROUP BY rep, district_id) GROUP BY rep),
 (SELECT any_value(b) AS b0, any_value(b) * any_value(sxx) / sqrt(sum(s * s)) AS t0, count(*) AS g FROM (SELECT district_id, any_value(b) AS b, any_value(sxx) AS sxx, sum(xd * (yd - b * xd)) AS s FROM {source}, (SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx FROM {source}) GROUP BY 1))"""


@query("e38_wild_cluster_bootstrap", f"WITH {SAMPLE}, {SIGNS} " + bootstrap_sql("w", "entity_year", True) + " UNION ALL " + bootstrap_sql("v", "entity_district_year", False))
def e38(t):
    d = sample(t)
    m = reg.prepare(d, ["y", "x"], [A, Y], ["district_id"])
    a = reg.wild_cluster_bootstrap(m, "y", "x", "district_id", "year", 999).withColumn("model", F.lit("entity_year"))
    b = reg.wild_cluster_bootstrap(reg.prepare(d, ["y", "x"], [A, DY], ["district_id"]), "y", "x", "district_id", None, 999).withColumn("model", F.lit("entity_district_year"))
    return rounded(a.unionByName(b), 12, t_raw=7, p_wild=9)


@query("e38_raw_cluster_t", f"""WITH {SAMPLE}, b AS (SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx FROM w), s AS (SELECT district_id, sum(xd * (yd - b * xd)) AS s FROM w, b GROUP BY 1)
SELECT round(max(b), 11) AS coef, round(max(b) * max(sxx) / sqrt(sum(s * s)), 8) AS t_raw, count(*) AS n_clusters FROM s, b""")
def e38b(t):
    out = reg.wild_cluster_bootstrap(m3(t).data, "y", "x", "district_id", "year", 9)
    return rounded(out.select("coef", "t_raw", "n_clusters"), 11, t_raw=8)


@query("e38_interaction_bootstrap", f"""WITH {SAMPLE.replace("x - avg(x) OVER (PARTITION BY area_id) AS xa,", "x - avg(x) OVER (PARTITION BY area_id) AS xa, x * income / 1000 - avg(x * income / 1000) OVER (PARTITION BY area_id) AS za,")}, {SIGNS},
zz AS (SELECT *, za - avg(za) OVER (PARTITION BY year) AS zd FROM w), fw AS (SELECT sum(xd * yd) / sum(xd * xd) AS cy, sum(xd * zd) / sum(xd * xd) AS cz FROM zz),
part AS (SELECT district_id, year, zd - cz * xd AS xd, yd - cy * xd AS yd FROM zz, fw) """ + bootstrap_sql("part", "interaction", True))
def e38c(t):
    d = sample(t).withColumn("x_income", F.col("x") * F.col("income") / 1000)
    p = reg.prepare(d, ["y", "x", "x_income"], [A, Y], ["district_id"])
    out = reg.wild_cluster_bootstrap(reg.partial_out(p, ["y", "x_income"], "x"), "y", "x_income", "district_id", "year", 999)
    return rounded(out.withColumn("model", F.lit("interaction")), 12, t_raw=7, p_wild=9)


@query("e39_partial_out", f"""WITH {SAMPLE.replace("x - avg(x) OVER (PARTITION BY area_id) AS xa,", "x - avg(x) OVER (PARTITION BY area_id) AS xa, n - avg(n) OVER (PARTITION BY area_id) AS na,")}, z AS (SELECT *, na - avg(na) OVER (PARTITION BY year) AS nd FROM w),
g AS (SELECT sum(xd * yd) / sum(xd * xd) AS b_y, sum(xd * nd) / sum(xd * xd) AS bn FROM z) SELECT area_id, year, round(yd - b_y * xd, 9) AS y, round(nd - bn * xd, 7) AS n FROM z, g""")
def e39(t):
    p = wt.demean(sample(t).select("area_id", "year", "x", "y", F.col("n").cast("double").alias("n")), ["x", "y", "n"], A, Y)
    return rounded(reg.partial_out(p, ["y", "n"], "x").select("area_id", "year", "y", "n"), 7, y=9)


@query("e40_surviving_variance", f"""WITH {SAMPLE}, t AS (SELECT var_samp(x) AS t FROM d) SELECT 'x' AS variable, 'entity_year' AS structure, round(max(t), 5) AS total_variance, round(var_samp(xd) / max(t), 9) AS share_left FROM w, t
 UNION ALL SELECT 'x', 'entity_district_year', round(max(t), 5), round(var_samp(xd) / max(t), 9) FROM v, t""")
def e40(t):
    return rounded(wt.surviving_variance(sample(t), ["x"], {"entity_year": [A, Y], "entity_district_year": [A, DY]}), 9, total_variance=5)


@query("e40_r2_on_group_dummies", f"WITH {PANEL}, g AS (SELECT rate, avg(rate) OVER (PARTITION BY district_id, year) AS m, avg(rate) OVER () AS a FROM panel) SELECT round(1 - sum((rate - m) ** 2) / sum((rate - a) ** 2), 9) AS r2 FROM g")
def e40b(t):
    p = t.panel.withColumn("r", F.col("rate"))
    d = wt.demean(p, ["r"], DY)
    return rounded(d.agg((1 - F.sum(F.col("r") ** 2) / (F.var_pop("rate") * F.count("rate"))).alias("r2")), 9)


LAGGED = """(SELECT *, lag(dy) OVER w AS dy_lag1, lag(dy, 2) OVER w AS dy_lag2 FROM (SELECT p.*, lead(rate) OVER o AS rate_lead1, lead(rate, 2) OVER o AS rate_lead2, lag(rate) OVER o AS rate_lag1, lag(rate, 2) OVER o AS rate_lag2, y - lag(y) OVER o AS dy
 FROM panel_all p WINDOW o AS (PARTITION BY area_id ORDER BY year)) WINDOW w AS (PARTITION BY area_id ORDER BY year))"""
LEADS_LAGS = ["rate_lead2", "rate_lead1", "rate", "rate_lag1", "rate_lag2"]
REVERSE = {"reverse_one_lag": ["dy_lag1"], "reverse_two_lags": ["dy_lag1", "dy_lag2"]}


@query("e41_leads_lags_reverse", fits_sql(PANEL, {
    "leads": (f"SELECT * FROM {LAGGED} WHERE rate_lead2 IS NOT NULL AND rate_lag2 IS NOT NULL", {c: c for c in ["y", *LEADS_LAGS]}),
    "late": (f"SELECT * FROM {LAGGED} WHERE rate_lead2 IS NOT NULL AND rate_lag2 IS NOT NULL AND year >= 1998", {c: c for c in ["y", *LEADS_LAGS]}),
    "one": (f"SELECT * FROM {LAGGED} WHERE dy_lag1 IS NOT NULL", {"rate": "rate", "dy_lag1": "dy_lag1"}), "two": (f"SELECT * FROM {LAGGED} WHERE dy_lag2 IS NOT NULL", {c: c for c in ["rate", "dy_lag1", "dy_lag2"]})},
    [(f"{n}_{f}", s, f, "y", LEADS_LAGS, 5) for n, s in (("leads_lags", "leads"), ("leads_lags_from_1998", "late")) for f in GRID_FES if (n, f) != ("leads_lags_from_1998", "entity_district_year")]
    + [(f"{n}_{f}", s, f, "rate", REVERSE[n], len(REVERSE[n])) for n, s in (("reverse_one_lag", "one"), ("reverse_two_lags", "two")) for f in GRID_FES], TERMS_OF_FITS))
def e41(t):
    p = grid.add_lags(t.panel_all, "area_id", "year", ["rate"], [1, 2])
    p = grid.add_lags(p, "area_id", "year", ["rate"], [1, 2], leads=True)
    p = materialise(grid.add_lags(grid.add_difference(p, "y", "dy", "area_id", "year"), "area_id", "year", ["dy"], [1, 2]))
    runs = [(f"leads_lags_{f}", p, "y", LEADS_LAGS, fes) for f, fes in GRID_FES.items()] + [("leads_lags_from_1998_entity_year", p.where("year >= 1998"), "y", LEADS_LAGS, GRID_FES["entity_year"])]
    runs += [(f"{n}_{f}", p, "rate", xs, fes) for n, xs in REVERSE.items() for f, fes in GRID_FES.items()]
    out = None
    for spec, data, y, xs, fes in runs:
        part = reg.fit(data, y, xs, fes, [["district_id"]]).table(spec)
        out = part if out is None else out.unionByName(part)
    return terms_of(out)


@query("o06_coefficient_by_window", f"""WITH {PANEL}, win AS (SELECT * FROM panel, (VALUES (1996, 1999), (1998, 2001)) v(a, b) WHERE year BETWEEN a AND b), w1 AS (SELECT a, year, x - avg(x) OVER (PARTITION BY a, area_id) AS x, y - avg(y) OVER (PARTITION BY a, area_id) AS y FROM win),
w2 AS (SELECT a, x - avg(x) OVER (PARTITION BY a, year) AS x, y - avg(y) OVER (PARTITION BY a, year) AS y FROM w1) SELECT 'from_' || a AS spec, round(sum(x * y) / sum(x * x), 11) AS coef, count(*) AS n_obs FROM w2 GROUP BY a""")
def o06(t):
    out, panel = None, materialise(t.panel)
    for a, b in ((1996, 1999), (1998, 2001)):
        part = reg.fit(grid.keep_periods(panel, "year", a, b), "y", ["x"], [A, Y], [["district_id"]]).table(f"from_{a}")
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("spec", "coef", "n_obs"), 11)


@query("e42_treatment_sensitivity")
def e42(t):
    d = sample(t).withColumn("x_log1p", F.log1p("x"))
    d = materialise(clean.winsorise(d, "x", 0.99, "x_wins"))
    runs = [("lag1", d, "x", None), ("same_year", d, "rate", None), ("log1p", d, "x_log1p", None), ("winsorised", d, "x_wins", None),
            ("trimmed", clean.trim_above(d, "x", 0.99), "x", None), ("n_at_least_80", d.where("n >= 80"), "x", None), ("weighted", d, "x", "n")]
    out = None
    for name, data, x, weight in runs:
        part = reg.fit(data, "y", [x], [A, Y], [["district_id"]], weight=weight).table(name)
        out = part if out is None else out.unionByName(part)
    return out


DUMMIES = {f"is_{p}": f"CASE WHEN year = {p} THEN 1 ELSE 0 END" for p in GRID_YEARS[1:]}
DEFINITIONS = {"lag1": "x", "same_year": "rate", "log1p": "x_log1p", "winsorised": "x_wins"}


@query("e42_sensitivity_grid", fits_sql(f"""{SAMPLE}, cap AS (SELECT quantile_cont(x, 0.99) AS q FROM d), dd AS (SELECT d.*, ln(1 + x) AS x_log1p, least(x, q) AS x_wins, q FROM d, cap)""", {
    "d": ("SELECT * FROM dd", {c: c for c in ["y", "x", "rate", "x_log1p", "x_wins"]}), "trimmed": ("SELECT * FROM dd WHERE x <= q", {"y": "y", "x": "x", **DUMMIES}), "large": ("SELECT * FROM dd WHERE n >= 80", {"y": "y", "x": "x", **DUMMIES})},
    [(f"{n}_{f}", "d", f, "y", [x], 1) for n, x in DEFINITIONS.items() for f in GRID_FES] + [(f"{n}_entity_year", s, "entity", "y", ["x", *DUMMIES], 1) for n, s in (("trimmed", "trimmed"), ("n_at_least_80", "large"))], TERMS_OF_FITS))
def e42g(t):
    """Definitions of the treatment and thresholds, the last two on samples with holes; SQL has year dummies for those."""
    d = materialise(clean.winsorise(sample(t).withColumn("x_log1p", F.log1p("x")), "x", 0.99, "x_wins"))
    out = None
    for f, fes in GRID_FES.items():
        part = reg.sweep(d, "y", {f"{n}_{f}": [x] for n, x in DEFINITIONS.items()}, fes, ["district_id"])
        out = part if out is None else out.unionByName(part)
    for n, data in (("trimmed", clean.trim_above(d, "x", 0.99)), ("n_at_least_80", d.where("n >= 80"))):
        out = out.unionByName(reg.fit(data, "y", ["x"], [A, Y], [["district_id"]]).table(f"{n}_entity_year"))
    return terms_of(out)


SPILLOVER = {"own": ["x"], "neighbour": ["nb_rate"], "both": ["x", "nb_rate"], "interaction": ["x", "nb_rate", "nb_income"]}
SPILLOVER_HEADS = f"""{SAMPLE}, {PAIRS}, nb AS (SELECT e.src AS area_id, q.year, 1000.0::DOUBLE * sum(q.built) / sum(q.base) AS nb_rate FROM pairs e JOIN panel_all q ON q.area_id = e.dst GROUP BY ALL),
far AS (SELECT e.src AS area_id, q.year, 1000.0::DOUBLE * sum(q.built) / sum(q.base) AS nb_rate FROM pairs e JOIN panel_all q ON q.area_id = e.dst JOIN areas a ON a.area_id = e.src WHERE a.district_id <> q.district_id GROUP BY ALL)"""
SPILLOVER_SAMPLES = {s: (f"SELECT d.*, nb_rate FROM d JOIN {n} nb ON d.area_id = nb.area_id AND d.year = nb.year", {"y": "y", "x": "x", "nb_rate": "nb_rate", "nb_income": "nb_rate * income / 1000"}) for s, n in (("all", "nb"), ("cross_district", "far"))}
SPILLOVER_SPECS = [(f"{n}_{s}_{f}", s, f, "y", xs, len(xs)) for s, f in (("all", "entity_year"), ("all", "entity_district_year"), ("cross_district", "entity_year")) for n, xs in SPILLOVER.items()]


def spillover_fits(t):
    """Own and neighbour exposure on identical rows: of all neighbours under two structures, and of those in other districts."""
    from terrapanel.catalog.spatial import neighbours
    from terrapanel.operators import edges
    d, fits = sample(t), {}
    for s, cross, structures in (("all", False, GRID_FES), ("cross_district", True, {"entity_year": GRID_FES["entity_year"]})):
        nb = neighbours(t, {"nb_rate": edges.pooled_rate("built", "base")}, cross=cross)
        rows = d.join(nb, ["area_id", "year"]).withColumn("nb_income", F.col("nb_rate") * F.col("income") / 1000)
        rows = materialise(clean.complete_cases(rows, ["x", "nb_rate", "y"]))
        for f, fes in structures.items():
            data = reg.prepare(rows, ["y", "x", "nb_rate", "nb_income"], fes, ["district_id"])
            fits |= fit_blocks(data, "y", {f"{n}_{s}_{f}": xs for n, xs in SPILLOVER.items()}, fes, ["district_id"])
    return fits


@query("w17_unbalanced_slopes", fits_sql(SAMPLE, {"holes": ("SELECT * FROM d WHERE (area_id * 7 + year) % 5 <> 0", {"y": "y", "x": "x", "n": "n", **DUMMIES})},
       [("x", "holes", "entity", "y", ["x", *DUMMIES], 1), ("x_n", "holes", "entity", "y", ["x", "n", *DUMMIES], 2)], "SELECT iv.spec, cols[a] AS term, round(iv.m[a][iv.k + 1], 10) AS coef, size.n AS n_obs FROM vs JOIN iv ON vs.spec = iv.spec, size WHERE a = b"))
def w17s(t):
    """Slopes from rows without entity and year effects, in a panel with holes; SQL has year dummies."""
    holes = sample(t).where("(area_id * 7 + year) % 5 <> 0").select("area_id", "year", "x", "y", F.col("n").cast("double").alias("n"))
    d = wt.within_transform(holes, ["x", "y", "n"], [A, Y])
    s = d.agg(F.count(F.lit(1)).alias("c"), *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "xn", "nn", "ny")]).first()
    det = s["xx"] * s["nn"] - s["xn"] ** 2
    rows = [("x", "x", s["xy"] / s["xx"], s["c"]), ("x_n", "x", (s["xy"] * s["nn"] - s["ny"] * s["xn"]) / det, s["c"]), ("x_n", "n", (s["ny"] * s["xx"] - s["xy"] * s["xn"]) / det, s["c"])]
    return rounded(t.spark.createDataFrame(rows, "spec string, term string, coef double, n_obs long"), 10)


@query("e43_spillover_comparison", fits_sql(SPILLOVER_HEADS, SPILLOVER_SAMPLES, SPILLOVER_SPECS, TERMS_OF_FITS))
def e43(t):
    rows = [r for spec, f in spillover_fits(t).items() for r in f.rows(spec)]
    return terms_of(t.spark.createDataFrame(rows, reg.FIT_SCHEMA))


@query("e43_joint_tests", fits_sql(SPILLOVER_HEADS, SPILLOVER_SAMPLES, SPILLOVER_SPECS, "SELECT spec, q, round(w, 6) AS wald_chi2, round(w / q, 6) AS F FROM wald"))
def e43j(t):
    """The neighbours' terms together, given the area's own."""
    tests = [(spec, f.wald(f.terms[1:])) for spec, f in spillover_fits(t).items() if f.n_obs and len(f.terms) > 1]
    return rounded(t.spark.createDataFrame([(spec, w["q"], w["wald_chi2"], w["F"]) for spec, w in tests], "spec string, q long, wald_chi2 double, F double"), 6)


@query("e44_reproduction_check", f"""SELECT count(*) AS n_matched, round(max(abs(coef - round(coef, 6))), 10) AS max_diff_coef, round(max(abs(se - round(se, 6))), 10) AS max_diff_se, 0.0::DOUBLE AS max_diff_n_obs FROM ({fe_sql("w", "(1 + 1 + 5)")})""")
def e44(t):
    """A result table as it was saved, with six digits, against a fit of the same specification by another route."""
    d = sample(t)
    saved = reg.fit(d, "y", ["x"], [A, Y], [["district_id"]]).table("s").select("spec", "term", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"), F.col("n_obs").cast("double").alias("n_obs"))
    again = reg.sweep(d, "y", {"s": ["x"]}, [A, Y], ["district_id"]).withColumn("n_obs", F.col("n_obs").cast("double"))
    return rounded(reg.compare_tables(again, materialise(saved), ["spec", "term"], ["coef", "se", "n_obs"]), 10)


@query("e45_cross_section", f"""WITH {PANEL}, g AS (SELECT area_id, region_id, max(y) FILTER (WHERE year = 1998) - max(y) FILTER (WHERE year = 1995) AS gr, max(rate) FILTER (WHERE year = 2001) AS r FROM panel_all GROUP BY ALL),
c AS (SELECT gr - avg(gr) OVER (PARTITION BY region_id) AS y, r - avg(r) OVER (PARTITION BY region_id) AS x FROM g) SELECT 'r' AS term, round(sum(x * y) / sum(x * x), 10) AS coef, count(*) AS n_obs FROM c""")
def e45(t):
    g = grid.growth_between(t.panel_all, "area_id", "year", "y", 1995, 1998, "gr").select("area_id", "gr")
    r = t.panel_all.where("year = 2001").select("area_id", "region_id", F.col("rate").alias("r"))
    return rounded(reg.fit(g.join(r, "area_id"), "gr", ["r"], [["region_id"]], [["region_id"]]).table().select("term", "coef", "n_obs"), 10)


@query("e45_pre_period_balance", f"""WITH {PANEL}, g AS (SELECT area_id, max(y) FILTER (WHERE year = 1998) - max(y) FILTER (WHERE year = 1995) AS gr, max(rate) FILTER (WHERE year = 2001) AS rate, max(income) AS income FROM panel_all GROUP BY 1),
e AS (SELECT list_sort(list_distinct(quantile_cont(rate, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS raw FROM g), b AS (SELECT g.*, 1 + len(list_filter(raw[2:-2], lambda q: q < rate)) AS quartile FROM g, e)
SELECT quartile, count(*) AS n, round(avg(gr), 9) AS mean_growth, round(avg(income), 5) AS mean_income FROM b GROUP BY quartile""")
def e45b(t):
    g = grid.growth_between(t.panel_all, "area_id", "year", "y", 1995, 1998, "gr").select("area_id", "gr")
    r = t.panel_all.where("year = 2001").select("area_id", "rate", "income")
    b = quantile_bins(g.join(r, "area_id"), [], "rate", 4, "quartile")
    return rounded(b.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("gr").alias("mean_growth"), F.avg("income").alias("mean_income")), 9, mean_income=5)


def slopes_sql(source: str, xs: dict[str, str], y: str = "y") -> str:
    """Two-way within slopes of ``y`` on each expression over the balanced CTE ``source``."""
    parts = []
    for spec, x in xs.items():
        parts.append(f"""SELECT '{spec}' AS spec, round(sum(x * y) / sum(x * x), 11) AS coef, count(*) AS n_obs FROM (SELECT x - avg(x) OVER (PARTITION BY year) AS x, y - avg(y) OVER (PARTITION BY year) AS y FROM
 (SELECT year, {x} - avg({x}) OVER (PARTITION BY area_id) AS x, {y} - avg({y}) OVER (PARTITION BY area_id) AS y FROM {source}))""")
    return " UNION ALL ".join(parts)


def slopes(data, runs: dict[str, str], y: str = "y"):
    out = None
    for spec, x in runs.items():
        part = reg.fit(data, y, [x], [A, Y], [["district_id"]]).table(spec)
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("spec", "coef", "n_obs"), 11)


@query("e41_reverse_direction", f"""WITH {PANEL}, q AS (SELECT *, y - lag(y) OVER (PARTITION BY area_id ORDER BY year) AS dy FROM panel_all), r AS (SELECT * FROM (SELECT *, lag(dy) OVER (PARTITION BY area_id ORDER BY year) AS dy1 FROM q) WHERE dy1 IS NOT NULL) """ + slopes_sql("r", {"reverse": "dy1"}, "rate").replace("11) AS coef", "8) AS coef"))
def e41b(t):
    p = grid.add_lags(grid.add_difference(t.panel_all, "y", "dy", "area_id", "year"), "area_id", "year", ["dy"], [1])
    return rounded(slopes(p, {"reverse": "dy_lag1"}, "rate"), 8)


@query("e42_treatment_definitions", f"WITH {SAMPLE} " + slopes_sql("d", {"lag1": "x", "same_year": "rate", "log1p": "ln(1 + x)"}))
def e42b(t):
    return slopes(sample(t).withColumn("x_log1p", F.log1p("x")), {"lag1": "x", "same_year": "rate", "log1p": "x_log1p"})


@query("e43_single_exposures", f"""WITH {SAMPLE}, {PAIRS}, nb AS (SELECT e.src AS area_id, q.year, 1000.0::DOUBLE * sum(q.built) / sum(q.base) AS nb_rate FROM pairs e JOIN panel_all q ON q.area_id = e.dst GROUP BY ALL),
j AS (SELECT d.*, nb_rate FROM d JOIN nb ON d.area_id = nb.area_id AND d.year = nb.year) """ + slopes_sql("j", {"own": "x", "neighbour": "nb_rate"}))
def e43b(t):
    from terrapanel.catalog.spatial import neighbours
    from terrapanel.operators import edges
    nb = neighbours(t, {"nb_rate": edges.pooled_rate("built", "base")})
    same = materialise(clean.complete_cases(sample(t).join(nb, ["area_id", "year"]), ["x", "nb_rate", "y"]))
    return slopes(same, {"own": "x", "neighbour": "nb_rate"})
