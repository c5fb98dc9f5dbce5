"""Distribution, movement, concentration and correlation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.catalog.base import PANEL, query, rounded
from terrapanel.operators import correlation, indexing, profile, ranks
from terrapanel.operators.quantiles import exact_quantiles, quantile_bins, with_value_ranks


@query("a03_exact_quantiles", """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.005) AS lo, median(l_extendedprice) AS mid, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem GROUP BY 1""".replace(
    "quantile_cont(l_extendedprice, 0.005)", "round(quantile_cont(l_extendedprice, 0.005), 5)").replace("median(l_extendedprice)", "round(median(l_extendedprice), 5)").replace(
    "quantile_cont(l_extendedprice, 0.995)", "round(quantile_cont(l_extendedprice, 0.995), 5)"))
def a03(t):
    return rounded(exact_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"lo": 0.005, "mid": 0.5, "hi": 0.995}), 5)


@query("a17_describe", """SELECT l_linestatus, v AS variable, count(x) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS sd, min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.1), 8) AS p10, round(quantile_cont(x, 0.9), 8) AS p90
 FROM (SELECT l_linestatus, 'l_quantity' AS v, l_quantity AS x FROM lineitem UNION ALL SELECT l_linestatus, 'l_tax', l_tax FROM lineitem) GROUP BY ALL""")
def a17(t):
    return rounded(profile.describe(t.lineitem, ["l_quantity", "l_tax"], ["l_linestatus"], {"p10": 0.1, "p90": 0.9}), 8, min=None, max=None)


DIST = """SELECT v AS variable, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS min, max(x) AS max, round(s, 6) AS skew, round(kurtosis_pop(x), 6) AS excess_kurtosis,
 round(avg((x = 0)::INT), 8) AS share_zero, round(count(x) / 6.0 * (s * s + kurtosis_pop(x) ** 2 / 4.0), 3) AS jb, round(exp(-count(x) / 12.0 * (s * s + kurtosis_pop(x) ** 2 / 4.0)), 8) AS jb_p, round(skewness(x), 6) AS skew_sample,
 round(quantile_cont(x, 0.01), 6) AS p1, round(quantile_cont(x, 0.25), 6) AS p25, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.99), 6) AS p99
 FROM (SELECT v, x, skewness(x) OVER (PARTITION BY v) * (count(x) OVER (PARTITION BY v) - 2) / sqrt(count(x) OVER (PARTITION BY v)::DOUBLE * (count(x) OVER (PARTITION BY v) - 1)) AS s FROM
 (SELECT 'c_acctbal' AS v, c_acctbal AS x FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey FROM customer)) GROUP BY v, s"""


@query("a18_distribution", DIST)
def a18(t):
    return rounded(profile.distribution(t.customer, ["c_acctbal", "c_nationkey"]), 6, share_zero=8, jb=3, jb_p=8, min=None, max=None).select(
        "variable", "n", "mean", "sd", "min", "max", "skew", "excess_kurtosis", "share_zero", "jb", "jb_p", "skew_sample", "p1", "p25", "median", "p75", "p99")


@query("a19_sample_skew", f"WITH {PANEL} SELECT 'rate' AS variable, round(skewness(rate), 8) AS skew_sample FROM panel_all")
def a19(t):
    return rounded(profile.distribution(t.panel_all, ["rate"]).select("variable", "skew_sample"), 8)


@query("a20_modal_share", "SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS n_values, max(c) AS top_n, round(max(c) / sum(c), 10) AS top_share FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)")
def a20(t):
    return rounded(profile.modal_share(t.lineitem, "l_quantity"), 10)


QUART = f"""WITH {PANEL}, q AS (SELECT area_id, ntile(4) OVER (ORDER BY b95, area_id) AS q_old, ntile(4) OVER (ORDER BY b01, area_id) AS q_new, b95, b01 FROM
 (SELECT area_id, max(rate) FILTER (WHERE year = 1995) AS b95, max(rate) FILTER (WHERE year = 2001) AS b01 FROM panel_all GROUP BY 1))"""


def quartiles(t):
    g = t.panel_all.groupBy("area_id").agg(F.max(F.when(F.col("year") == 1995, F.col("rate"))).alias("b95"), F.max(F.when(F.col("year") == 2001, F.col("rate"))).alias("b01"))
    g = ranks.with_tile(g, "b95", "area_id", 4, "q_old")
    return ranks.with_tile(g, "b01", "area_id", 4, "q_new")


@query("a15_transition_matrix", QUART + " SELECT q_old, q_new, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY q_old), 10) AS row_share FROM q GROUP BY 1, 2")
def a15(t):
    return rounded(profile.crosstab(quartiles(t), "q_old", "q_new"), 10)


@query("a16_quartile_movement", QUART + """ SELECT count(*) AS n, round(avg((q_old <> q_new)::INT), 10) AS share_changed, round(avg((abs(q_old - q_new) >= 2)::INT), 10) AS share_two_or_more,
 round(avg((q_new = 4)::INT) FILTER (WHERE q_old = 4), 10) AS top_stays_top FROM q""")
def a16(t):
    return rounded(profile.movement(quartiles(t), "q_old", "q_new", 4), 10)


@query("a25_standardised_difference", f"""WITH {PANEL}, l AS (SELECT n < 85 AS low, 'income' AS variable, income AS v FROM panel_all UNION ALL SELECT n < 85, 'base', base FROM panel_all)
SELECT variable, round(avg(v) FILTER (WHERE low), 6) AS mean_low, round(avg(v) FILTER (WHERE NOT low), 6) AS mean_rest, count(v) FILTER (WHERE low) AS n_low,
 round((avg(v) FILTER (WHERE low) - avg(v) FILTER (WHERE NOT low)) / sqrt((var_samp(v) FILTER (WHERE low) + var_samp(v) FILTER (WHERE NOT low)) / 2), 8) AS std_mean_diff FROM l GROUP BY variable""")
def a25(t):
    return rounded(profile.standardised_difference(t.panel_all, F.col("n") < 85, ["income", "base"]), 6, std_mean_diff=8)


@query("a29_group_means", f"WITH {PANEL} SELECT region_id, year, count(*) AS n, round(avg(rate), 6) AS mean_rate, round(avg(y), 8) AS mean_y FROM panel_all GROUP BY 1, 2")
def a29(t):
    return rounded(t.panel_all.groupBy("region_id", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("rate").alias("mean_rate"), F.avg("y").alias("mean_y")), 6, mean_y=8)


BINS = """e AS (SELECT list_distinct(quantile_cont(m, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS raw FROM m),
b AS (SELECT m.*, 1 + len(list_filter(list_sort(raw)[2:-2], lambda v: v < m)) AS bin FROM m, e)"""


@query("a30_decile_profile", f"""WITH {PANEL}, m AS (SELECT area_id, avg(n) AS m, max(income) AS income FROM panel_all GROUP BY 1), {BINS}
SELECT bin, count(*) AS n_entities, round(avg(m), 6) AS mean_n, round(avg(income), 6) AS mean_income FROM b GROUP BY bin""")
def a30(t):
    return rounded(profile.decile_profile(t.panel_all, "area_id", "n", ["income"]))


@query("a31_restricted_moments", f"""WITH {PANEL}, r AS (SELECT 'all' AS restriction, * FROM panel_all UNION ALL SELECT 'n80', * FROM panel_all WHERE n >= 80), s AS (SELECT restriction, 'income' AS variable, income AS v, n AS w FROM r UNION ALL SELECT restriction, 'rate', rate, n FROM r)
SELECT restriction, variable, count(v) AS n, round(sum(w * v) / sum(w), 5) AS mean, round(sqrt(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2), 4) AS sd FROM s GROUP BY ALL""")
def a31(t):
    return rounded(profile.restricted_moments(t.panel_all, ["income", "rate"], {"all": F.lit(True), "n80": F.col("n") >= 80}, "n"), 5, sd=4)


@query("a31_weight_share", f"WITH {PANEL} SELECT region_id, round(sum(n) / (SELECT sum(n) FROM panel_all), 10) AS weight_share FROM panel_all GROUP BY region_id")
def a31b(t):
    return rounded(profile.weight_share(t.panel_all, "region_id", "n", "weight_share"), 10)


@query("a32_variance_parts", f"""WITH {PANEL}, d AS (SELECT rate AS v, avg(rate) OVER (PARTITION BY area_id) AS m FROM panel_all)
SELECT 'rate' AS variable, round(stddev_samp(v), 8) AS overall_sd, round(stddev_samp(v - m), 8) AS within_sd, round(var_samp(v - m) / var_samp(v), 8) AS within_share,
 (SELECT round(stddev_samp(m), 8) FROM (SELECT avg(rate) AS m FROM panel_all GROUP BY area_id)) AS between_sd FROM d""")
def a32(t):
    return rounded(profile.variance_parts(t.panel_all, "area_id", ["rate"]), 8)


@query("a38_evaluation_grid", f"""WITH {PANEL} SELECT q AS quantile, round(v, 6) AS x_value, z FROM (SELECT unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS q, unnest(quantile_cont(x, [0.25, 0.5, 0.75, 0.9])) AS v FROM panel), (VALUES (-1.0::DOUBLE), (0.0), (1.0)) t(z)""")
def a38(t):
    return rounded(profile.evaluation_grid(t.panel, "x", [0.25, 0.5, 0.75, 0.9], [-1.0, 0.0, 1.0]))


@query("t04_ranked_correlations", f"""WITH {PANEL} SELECT * FROM (SELECT 'n' AS a, 'x' AS b, count(*) AS n, round(corr(n, x), 8) AS r FROM panel UNION ALL SELECT 'n', 'y', count(*), round(corr(n, y), 8) FROM panel UNION ALL SELECT 'x', 'y', count(*), round(corr(x, y), 8) FROM panel) ORDER BY abs(r) DESC""")
def t04(t):
    return rounded(correlation.ranked_pairs(correlation.cross_moments(t.panel, ["n", "x", "y"])), 8)


def pair_sql(src: str, level: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 7) AS r, '{level}' AS level FROM {src}" for a, b in (("x", "y"), ("x", "n"), ("y", "n")))


WITHIN = f"""WITH {PANEL}, e AS (SELECT area_id, avg(x) AS x, avg(y) AS y, avg(n) AS n FROM panel GROUP BY 1),
w AS (SELECT p.year, p.x - e.x AS x, p.y - e.y AS y, p.n - e.n AS n FROM panel p JOIN e USING (area_id)), wt AS (SELECT year, avg(x) AS x, avg(y) AS y, avg(n) AS n FROM w GROUP BY 1),
w2 AS (SELECT w.x - wt.x AS x, w.y - wt.y AS y, w.n - wt.n AS n FROM w JOIN wt USING (year))"""


@query("e19_pearson_levels", f"{WITHIN} {pair_sql('panel', 'pooled')} UNION ALL {pair_sql('e', 'between')} UNION ALL {pair_sql('w', 'within')} UNION ALL {pair_sql('w2', 'two_way_within')}")
def e19(t):
    return rounded(correlation.pearson_levels(t.panel.select("area_id", "year", "x", "y", F.col("n").cast("double").alias("n")), ["x", "y", "n"], "area_id", "year"), 7)


@query("e19_pearson_by_year", f"WITH {PANEL} SELECT year, 'x' AS a, 'y' AS b, count(*) AS n, round(corr(x, y), 8) AS r FROM panel GROUP BY year")
def e19y(t):
    return rounded(correlation.cross_moments(t.panel, ["x", "y"], ["year"]), 8)


@query("e20_spearman", f"""WITH {PANEL}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn FROM panel)
SELECT 'x' AS a, 'n' AS b, count(*) AS n, round(corr(rx, rn), 8) AS r FROM r""")
def e20(t):
    return rounded(correlation.spearman(t.panel.select("x", "n"), ["x", "n"]), 8)


@query("e21_partial_correlations", f"""WITH {PANEL}, c AS (SELECT corr(x, y) AS xy, corr(x, n) AS xn, corr(y, n) AS yn FROM panel)
SELECT 'x' AS a, 'y' AS b, round((xy - xn * yn) / sqrt((1 - xn ** 2) * (1 - yn ** 2)), 8) AS partial_r FROM c UNION ALL
SELECT 'x', 'n', round((xn - xy * yn) / sqrt((1 - xy ** 2) * (1 - yn ** 2)), 8) FROM c UNION ALL SELECT 'y', 'n', round((yn - xy * xn) / sqrt((1 - xy ** 2) * (1 - xn ** 2)), 8) FROM c""")
def e21(t):
    return rounded(correlation.partial_correlations(t.panel, ["x", "y", "n"]), 8)


@query("e22_vif", f"""WITH {PANEL}, c AS (SELECT corr(x, n) AS r FROM panel) SELECT 'x' AS regressor, round(1 / (1 - r * r), 8) AS vif FROM c UNION ALL SELECT 'n', round(1 / (1 - r * r), 8) FROM c""")
def e22(t):
    return rounded(correlation.vif(t.panel, ["x", "n"]), 8)


@query("e22_vif_within", f"{WITHIN}, c AS (SELECT corr(x, n) AS r FROM w2) SELECT 'x' AS regressor, round(1 / (1 - r * r), 7) AS vif FROM c UNION ALL SELECT 'n', round(1 / (1 - r * r), 7) FROM c")
def e22w(t):
    from terrapanel.operators.within import demean
    p = t.panel.select("area_id", "year", "x", F.col("n").cast("double").alias("n"))
    return rounded(correlation.vif(demean(p, ["x", "n"], ["area_id"], ["year"]), ["x", "n"]), 7)


@query("e24_binned_scatter", f"""WITH {PANEL}, m AS (SELECT x AS m, y FROM panel), {BINS} SELECT bin, count(*) AS n, round(avg(m), 6) AS mean_x, round(avg(y), 8) AS mean_y FROM b GROUP BY bin""")
def e24(t):
    return rounded(correlation.binned_scatter(t.panel, "x", "y", 10), 6, mean_y=8)


@query("e24_slope_by_group", f"WITH {PANEL} SELECT region_id, count(*) AS n, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 7) AS intercept, round(corr(y, x), 8) AS r FROM panel GROUP BY 1")
def e24s(t):
    return rounded(correlation.simple_regression(t.panel, "y", "x", ["region_id"]), 8, slope=9, intercept=7)


@query("e25_beta_convergence", f"""WITH {PANEL}, g AS (SELECT area_id, max(y) FILTER (WHERE year = 1996) AS s, max(y) FILTER (WHERE year = 2001) AS e FROM panel_all GROUP BY 1)
SELECT count(*) AS n, round(regr_slope(e - s, s), 8) AS slope, round(regr_intercept(e - s, s), 7) AS intercept, round(corr(e - s, s), 8) AS r FROM g""")
def e25(t):
    from terrapanel.operators.grid import growth_between
    g = growth_between(t.panel_all, "area_id", "year", "y", 1996, 2001, "growth")
    return rounded(correlation.simple_regression(g, "growth", "start_value"), 8, intercept=7)


EMB = "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(8)) + " FROM embeddings"


def emb(t):
    return t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])


@query("e26_pca_eigenvalues")
def e26(t):
    return rounded(correlation.pca(emb(t), [f"e{i}" for i in range(8)])[0], 8)


@query("e26_pca_loadings")
def e26l(t):
    return rounded(correlation.pca(emb(t), [f"e{i}" for i in range(8)])[1], 6)


@query("e26_pca_two_variables", f"""WITH e AS ({EMB}), c AS (SELECT corr(e0, e1) AS r, count(*) AS n FROM e)
SELECT 1::BIGINT AS component, round((1 + abs(r)) * n / (n - 1), 8) AS eigenvalue, round((1 + abs(r)) / 2, 8) AS share, round((1 + abs(r)) / 2, 8) AS cumulative FROM c
UNION ALL SELECT 2, round((1 - abs(r)) * n / (n - 1), 8), round((1 - abs(r)) / 2, 8), 1.0 FROM c""")
def e26two(t):
    return rounded(correlation.pca(emb(t), ["e0", "e1"])[0], 8)


@query("e26_pca_scores", f"""WITH e AS ({EMB}), z AS (SELECT vec_id, (e0 - avg(e0) OVER ()) / stddev_pop(e0) OVER () AS a, (e1 - avg(e1) OVER ()) / stddev_pop(e1) OVER () AS b FROM e), s AS (SELECT sign(avg(a * b)) AS s FROM z)
SELECT vec_id, round(abs(a + s * b) / sqrt(2.0), 6) AS size1 FROM z, s""")
def e26s(t):
    d = emb(t)
    _, _, vectors = correlation.pca(d, ["e0", "e1"])
    return rounded(correlation.pca_scores(d, ["e0", "e1"], vectors, 1).select("vec_id", F.abs("pc1").alias("size1")), 6)


@query("w06_ntile", "SELECT c_custkey, ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS q FROM customer")
def w06(t):
    return ranks.with_tile(t.customer, "c_acctbal", "c_custkey", 4, "q").select("c_custkey", "q")


@query("w07_spread_quartile", "SELECT c_custkey, CAST(ceil(row_number() OVER (ORDER BY c_nationkey, c_custkey) * 4.0 / count(*) OVER ()) AS BIGINT) AS q FROM customer")
def w07(t):
    return ranks.with_tile(t.customer, "c_nationkey", "c_custkey", 4, "q", "spread").select("c_custkey", "q")


@query("w08_zscore_sample", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 8) AS z FROM customer")
def w08(t):
    return rounded(indexing.add_zscores(t.customer.select("c_custkey", "c_acctbal"), {"c_acctbal": "z"}).select("c_custkey", "z"), 8)


@query("w09_zscore_population", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 8) AS z FROM customer")
def w09(t):
    return rounded(indexing.add_zscores(t.customer.select("c_custkey", "c_acctbal"), {"c_acctbal": "z"}, ddof=0).select("c_custkey", "z"), 8)


@query("w10_median_flag", "SELECT c_custkey, CAST(c_acctbal < (SELECT median(c_acctbal) FROM customer) AS BIGINT) AS below FROM customer")
def w10(t):
    return indexing.add_median_flag(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "below").select("c_custkey", "below")


@query("w11_quantile_bins", f"WITH m AS (SELECT c_custkey, c_nationkey::DOUBLE AS m FROM customer), {BINS} SELECT c_custkey, bin FROM b")
def w11(t):
    return quantile_bins(t.customer, [], "c_nationkey", 10, "bin").select("c_custkey", "bin")


@query("w12_rank_first_quartile", """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS rn, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(CASE WHEN rn <= 1 + (n - 1) * 0.25 THEN 1 WHEN rn <= 1 + (n - 1) * 0.5 THEN 2 WHEN rn <= 1 + (n - 1) * 0.75 THEN 3 ELSE 4 END AS BIGINT) AS q FROM r""")
def w12(t):
    return ranks.with_tile(t.customer, "c_nationkey", "c_custkey", 4, "q", "rank_bin").select("c_custkey", "q")


@query("w13_rank_decile", """SELECT c_custkey, CAST(ceil(10.0 * rank() OVER (ORDER BY c_nationkey DESC) / count(*) OVER ()) AS BIGINT) AS decile FROM customer""")
def w13(t):
    return indexing.add_decile(t.customer, "c_nationkey", "decile").select("c_custkey", "decile")


@query("w14_percentile_rank", """SELECT c_custkey, round((rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0) / count(*) OVER (), 10) AS pct FROM customer""")
def w14(t):
    r = with_value_ranks(t.customer, [], "c_nationkey")
    return rounded(r.select("c_custkey", (F.col("rank_avg") / F.col("group_n")).alias("pct")), 10)
