"""Dense grids, lags, panel checks and assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.catalog.base import PANEL, TX, query, rounded
from terrapanel.operators import clean, grid, profile, quality
from terrapanel.operators.joins import attach
from terrapanel.plans.treatment_panel import treatment_panel

COUNTS = f"""{TX}, counts AS (SELECT area_id, year, count(*) AS built FROM tx WHERE kind = 'R' AND l_linenumber = 1 GROUP BY ALL),
base AS (SELECT s_suppkey AS area_id, s_acctbal AS denom FROM supplier),
g AS (SELECT area_id, unnest(generate_series(1995, 2001)) AS year FROM base),
f AS (SELECT g.area_id, g.year, coalesce(built, 0) AS built, denom, 1000.0 * coalesce(built, 0) / NULLIF(denom, 0) AS rate FROM g
 LEFT JOIN counts c ON g.area_id = c.area_id AND g.year = c.year JOIN base b ON g.area_id = b.area_id),
lagged AS (SELECT *, lag(built, 1) OVER w AS built_lag1, lag(built, 2) OVER w AS built_lag2, lag(built, 3) OVER w AS built_lag3,
 lag(rate, 1) OVER w AS rate_lag1, lag(rate, 2) OVER w AS rate_lag2, lag(rate, 3) OVER w AS rate_lag3 FROM f WINDOW w AS (PARTITION BY area_id ORDER BY year))"""


def counts(t):
    return t.tx.where("kind = 'R' AND l_linenumber = 1").groupBy("area_id", "year").agg(F.count(F.lit(1)).alias("built"))


def base(t):
    return t.supplier.select(F.col("s_suppkey").alias("area_id"), F.col("s_acctbal").alias("denom"))


def treated(t):
    return treatment_panel(counts(t), base(t), "area_id", "year", "built", "denom", 1998, 2001)


@query("j09_dense_grid", "SELECT s_suppkey AS area_id, unnest(generate_series(1995, 2001)) AS year FROM supplier")
def j09(t):
    return grid.dense_grid(base(t), "area_id", "year", 1998, 2001, 3)


@query("j10_explicit_zeros", f"WITH {COUNTS} SELECT area_id, year, built FROM f")
def j10(t):
    cells = grid.dense_grid(base(t), "area_id", "year", 1995, 2001)
    return grid.fill_grid(cells, counts(t), ["area_id", "year"], ["built"])


@query("w02_lags_and_w05_lookback", f"""WITH {COUNTS} SELECT area_id, year, built, built_lag1, built_lag2, built_lag3, round(rate, 6) AS rate,
 round(rate_lag1, 6) AS rate_lag1, round(rate_lag2, 6) AS rate_lag2, round(rate_lag3, 6) AS rate_lag3 FROM lagged WHERE year BETWEEN 1998 AND 2001""")
def w02(t):
    return rounded(treated(t).drop("denom", "built_prev3", "rate_prev3"))


@query("w05_lookback_dropped", f"WITH {COUNTS} SELECT min(year) AS first_year, max(year) AS last_year, count(*) AS n, count(*) FILTER (WHERE built_lag3 IS NULL) AS n_without_lag3 FROM lagged WHERE year BETWEEN 1998 AND 2001")
def w05(t):
    return treated(t).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n"),
                          F.count_if(F.col("built_lag3").isNull()).alias("n_without_lag3"))


@query("w03_previous_three", f"""WITH {COUNTS} SELECT area_id, year, coalesce(built_lag1, 0) + coalesce(built_lag2, 0) + coalesce(built_lag3, 0) AS built_prev3,
 round(coalesce(rate_lag1, 0) + coalesce(rate_lag2, 0) + coalesce(rate_lag3, 0), 6) AS rate_prev3 FROM lagged WHERE year BETWEEN 1998 AND 2001""")
def w03(t):
    return rounded(treated(t).select("area_id", "year", "built_prev3", "rate_prev3"))


@query("w04_leads_differences", f"""WITH {PANEL}, d AS (SELECT area_id, year, lead(rate, 1) OVER w AS rate_lead1, lead(rate, 2) OVER w AS rate_lead2,
 y - lag(y) OVER w AS dy FROM panel_all WINDOW w AS (PARTITION BY area_id ORDER BY year))
SELECT area_id, year, round(rate_lead1, 6) AS rate_lead1, round(rate_lead2, 6) AS rate_lead2, round(dy, 8) AS dy,
 round(lag(dy) OVER (PARTITION BY area_id ORDER BY year), 8) AS dy_lag1 FROM d""")
def w04(t):
    p = grid.add_lags(t.panel_all, "area_id", "year", ["rate"], [1, 2], leads=True)
    p = grid.add_difference(p, "y", "dy", "area_id", "year")
    p = grid.add_lags(p, "area_id", "year", ["dy"], [1])
    return rounded(p.select("area_id", "year", "rate_lead1", "rate_lead2", "dy", "dy_lag1"), 6, dy=8, dy_lag1=8)


@query("w18_base_year_index", f"""WITH {PANEL}, r AS (SELECT region_id, year, avg(y) AS level FROM panel_all GROUP BY ALL)
SELECT region_id, year, round(level - max(CASE WHEN year = 1997 THEN level END) OVER (PARTITION BY region_id), 8) AS idx FROM r""")
def w18(t):
    r = t.panel_all.groupBy("region_id", "year").agg(F.avg("y").alias("level"))
    return rounded(grid.add_base_index(r, "level", "idx", "region_id", "year", 1997).select("region_id", "year", "idx"), 8)


@query("w19_running_sum", f"""WITH {PANEL} SELECT area_id, year, CAST(sum(built) OVER (PARTITION BY area_id ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM panel_all""")
def w19(t):
    return grid.add_running_sum(t.panel_all, "built", "total", "area_id", "year").select("area_id", "year", "total")


@query("w21_group_size", f"""WITH {PANEL} SELECT a.area_id, a.year, g.n_areas FROM panel_all a JOIN (SELECT district_id, count(DISTINCT area_id) AS n_areas FROM panel_all GROUP BY 1) g USING (district_id)""")
def w21(t):
    p = t.panel_all
    size = p.groupBy("district_id").agg(F.countDistinct("area_id").alias("n_areas"))
    return attach(p, size, ["district_id"]).select("area_id", "year", "n_areas")


@query("a01_group_count", f"WITH {TX} SELECT kind, status, count(*) AS n FROM tx GROUP BY kind, status ORDER BY n DESC")
def a01(t):
    return profile.group_counts(t.tx, ["kind", "status"])


@query("a04_conditional_share", f"WITH {TX} SELECT year, count(*) FILTER (WHERE kind = 'R') AS n_returned, round(count(*) FILTER (WHERE kind = 'R') / count(*), 10) AS share FROM tx GROUP BY year")
def a04(t):
    return rounded(t.tx.groupBy("year").agg(F.count_if(F.col("kind") == "R").alias("n_returned"), F.avg((F.col("kind") == "R").cast("double")).alias("share")), 10)


@query("a05_global_stats", """SELECT count(*) AS n_rows, count(g) AS n_both, round(avg(g), 8) AS mean_diff, round(stddev_samp(g), 8) AS sd_diff,
 round(avg(CASE WHEN abs(g) <= 0.03 THEN 1.0 ELSE 0.0 END), 8) AS share_within FROM (SELECT l_discount - l_tax AS g FROM lineitem)""")
def a05(t):
    return rounded(profile.global_stats(t.lineitem, "l_discount", "l_tax", 0.03), 8)


@query("a06_duplicate_keys", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a06(t):
    from terrapanel.operators.lookup import duplicate_keys
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_partkey"])


@query("a07_time_invariance", f"""WITH {PANEL} SELECT 'base' AS attribute, count(*) FILTER (WHERE d > 1) AS n_entities_varying FROM (SELECT count(DISTINCT base) AS d FROM panel_all GROUP BY area_id)
 UNION ALL SELECT 'n', count(*) FILTER (WHERE d > 1) FROM (SELECT count(DISTINCT n) AS d FROM panel_all GROUP BY area_id)
 UNION ALL SELECT 'x', count(*) FROM (SELECT area_id FROM panel_all GROUP BY area_id HAVING count(DISTINCT x) > 1 OR count(x) < count(*))""")
def a07(t):
    return quality.varying_attributes(t.panel_all, "area_id", ["base", "n", "x"])


@query("a21_missingness", f"""WITH {PANEL} SELECT year, 'x' AS variable, count(*) - count(x) AS n_missing, (count(*) - count(x)) / count(*) AS share_missing FROM panel_all GROUP BY year
 UNION ALL SELECT year, 'y', count(*) - count(y), (count(*) - count(y)) / count(*) FROM panel_all GROUP BY year""")
def a21(t):
    return quality.missingness(t.panel_all, ["x", "y"], ["year"])


@query("o03_missing_by_year", """SELECT year(o_orderdate)::BIGINT AS year, 'status_known' AS variable, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_missing,
 round(count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 10) AS share_missing FROM orders GROUP BY 1""")
def o03(t):
    o = t.orders.select(F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status_known"))
    return rounded(quality.missingness(o, ["status_known"], ["year"]), 10)


@query("a23_panel_balance", f"""WITH {PANEL} SELECT CAST(sum(r) AS BIGINT) AS n_rows, count(*) AS n_entities, min(p) AS min_periods, max(p) AS max_periods,
 min(lo) AS first_period, max(hi) AS last_period, CAST(sum(r - p) AS BIGINT) AS duplicate_keys FROM
 (SELECT area_id, count(*) AS r, count(DISTINCT year) AS p, min(year) AS lo, max(year) AS hi FROM panel_all GROUP BY 1)""")
def a23(t):
    return quality.key_report(t.panel_all, ["area_id", "year"], "area_id", "year")


@query("a24_identity_check", f"""WITH {TX}, w AS (SELECT area_id, year, count(*) AS n, count(*) FILTER (WHERE kind = 'A') AS a, count(*) FILTER (WHERE kind = 'N') AS b,
 count(*) FILTER (WHERE kind = 'R') AS c FROM tx GROUP BY ALL) SELECT year, count(*) AS n, CAST(max(abs(a + b + c - n)) AS DOUBLE) AS max_gap, bool_and(a + b + c = n) AS holds FROM w GROUP BY year""")
def a24(t):
    w = t.tx.groupBy("area_id", "year").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in "ANR"])
    return quality.identity_gaps(w, ["A", "N", "R"], "total", ["year"])


@query("a26_threshold_exposure", f"""WITH {PANEL} SELECT k AS threshold, count(*) FILTER (WHERE n < k) AS n_below, round(count(*) FILTER (WHERE n < k) / count(*), 10) AS share_below,
 count(DISTINCT CASE WHEN n < k THEN area_id END) AS n_entities_ever, round(count(*) FILTER (WHERE n < k AND year >= 1998) / count(*) FILTER (WHERE year >= 1998), 10) AS share_below_window
 FROM panel_all, (VALUES (70::BIGINT), (80), (90), (100)) v(k) GROUP BY k""")
def a26(t):
    return rounded(profile.threshold_exposure(t.panel_all, "n", "area_id", [70, 80, 90, 100], F.col("year") >= 1998), 10)


@query("a27_top_decile_share", f"""WITH {PANEL}, r AS (SELECT year, built, row_number() OVER (PARTITION BY year ORDER BY built DESC) AS rn, count(*) OVER (PARTITION BY year) AS m FROM panel_all)
SELECT year, round(sum(built) FILTER (WHERE rn <= floor(m * 0.1)) / sum(built), 10) AS top_share FROM r GROUP BY year""")
def a27(t):
    from terrapanel.operators.quantiles import top_share
    return rounded(top_share(t.panel_all, ["year"], "built", 0.1, "top_share"), 10)


@query("a28_zero_persistence", f"""WITH {COUNTS}, l AS (SELECT built, lag(built) OVER (PARTITION BY area_id ORDER BY year) AS p FROM f)
SELECT round(avg((built = 0)::INT) FILTER (WHERE p = 0), 10) AS p_zero_after_zero, round(avg((built = 0)::INT) FILTER (WHERE p > 0), 10) AS p_zero_after_positive FROM l""")
def a28(t):
    cells = grid.fill_grid(grid.dense_grid(base(t), "area_id", "year", 1995, 2001), counts(t), ["area_id", "year"], ["built"])
    return rounded(profile.persistence_of_zero(cells, "area_id", "year", "built"), 10)


@query("a33_growth_and_running_total", f"""WITH {PANEL}, g AS (SELECT area_id, max(y) FILTER (WHERE year = 1996) AS s, max(y) FILTER (WHERE year = 2001) AS e, CAST(sum(built) AS BIGINT) AS total_built FROM panel_all GROUP BY 1)
SELECT area_id, round(s, 8) AS start_value, round(e, 8) AS end_value, round(e - s, 8) AS growth, total_built FROM g""")
def a33(t):
    p = t.panel_all
    tot = p.groupBy("area_id").agg(F.sum("built").alias("total_built"))
    return rounded(grid.growth_between(p, "area_id", "year", "y", 1996, 2001, "growth").join(tot, "area_id"), 8)


@query("a34_yearly_series", f"""WITH {PANEL} SELECT year, round(avg(y), 8) AS mean_level, round(stddev_samp(y), 8) AS sd_level, CAST(sum(built) AS BIGINT) AS total,
 round(avg((built > 0)::INT), 8) AS share_any, round(quantile_cont(y, 0.1), 8) AS p10, round(median(y), 8) AS median_level, round(quantile_cont(y, 0.9), 8) AS p90 FROM panel_all GROUP BY year""")
def a34(t):
    return rounded(profile.yearly_series(t.panel_all, "year", "y", "built"), 8)


@query("a35_cell_counts", """WITH c AS (SELECT floor(c_acctbal / 500) AS gx, floor(c_custkey / 100) AS gy, count(*) AS k FROM customer GROUP BY ALL)
SELECT CASE WHEN k <= 3 THEN 'small' WHEN k <= 6 THEN 'medium' ELSE 'large' END AS size_band, count(*) AS n_cells, CAST(sum(k) AS BIGINT) AS n_events FROM c GROUP BY 1""")
def a35(t):
    c = t.customer.withColumn("gy", F.col("c_custkey") * 5)
    return profile.cell_sizes(c, F.col("c_acctbal"), F.col("gy"), 500.0, [(3, "small"), (6, "medium")], "large")


@query("a36_zero_group_share", """SELECT count(*) AS n_groups, count(*) FILTER (WHERE k = 0) AS n_zero, round(avg((k = 0)::INT), 10) AS share_zero FROM
 (SELECT l_suppkey, l_partkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS k FROM lineitem GROUP BY ALL)""")
def a36(t):
    return rounded(profile.conditional_zero_share(t.lineitem, ["l_suppkey", "l_partkey"], F.col("l_returnflag") != "R"), 10)


@query("a37_wide_and_long", f"WITH {PANEL} SELECT area_id, year, built FROM panel_all")
def a37(t):
    years = list(range(1995, 2002))
    wide = t.panel_all.groupBy("area_id").pivot("year", years).agg(F.max("built"))
    return wide.unpivot("area_id", [str(y) for y in years], "y", "built").select("area_id", F.col("y").cast("int").alias("year"), "built")


@query("q02_expected_counts", "SELECT count(*) AS n_rows, count(DISTINCT s_suppkey) AS n_keys FROM supplier")
def q02(t):
    s = t.supplier
    got = s.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("s_suppkey").alias("n_keys"))
    row = got.first()
    quality.require_counts(s, row["n_keys"], {"s_suppkey": row["n_rows"]})
    return got


RULES_SQL = f"""WITH {PANEL}, dup AS (SELECT coalesce(sum(c - 1), 0) AS d FROM (SELECT count(*) AS c FROM panel_all GROUP BY area_id, year))
SELECT 'in_scope' AS rule, count(*) FILTER (WHERE NOT region_id < 4) AS n_violations FROM panel_all UNION ALL
SELECT 'positive_base', count(*) FILTER (WHERE NOT base > 0) FROM panel_all UNION ALL
SELECT 'rate_range', count(*) FILTER (WHERE NOT (rate BETWEEN 0 AND 500)) FROM panel_all UNION ALL
SELECT 'x_present', count(*) FILTER (WHERE x IS NULL) FROM panel_all"""


@query("q04_panel_rules", RULES_SQL)
def q04(t):
    return quality.violations(t.panel_all, {"in_scope": F.col("region_id") < 4, "positive_base": F.col("base") > 0,
                                            "rate_range": quality.in_range("rate", 0, 500), "x_present": F.col("x").isNotNull()})


@query("q05_range_checks", """SELECT 'discount' AS rule, count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 0.05) AS n_violations FROM lineitem
 UNION ALL SELECT 'size', count(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 49) FROM lineitem""")
def q05(t):
    return quality.violations(t.lineitem, {"discount": quality.in_range("l_discount", 0, 0.05), "size": quality.in_range("l_quantity", 1, 49)})


@query("q06_duplicates_dropped", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer")
def q06(t):
    c = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return quality.drop_exact_duplicates(c.unionByName(c), ["c_custkey"])


@query("q07_sum_identities", f"WITH {COUNTS} SELECT count(*) AS n, CAST(0.0 AS DOUBLE) AS max_gap, true AS holds FROM lagged WHERE year BETWEEN 1998 AND 2001")
def q07(t):
    return quality.identity_gaps(treated(t), ["built_lag1", "built_lag2", "built_lag3"], "built_prev3")


@query("q08_recomputation", f"WITH {COUNTS} SELECT count(*) AS n, CAST(0.0 AS DOUBLE) AS max_gap, true AS holds FROM lagged WHERE year BETWEEN 1998 AND 2001")
def q08(t):
    grid_cells = grid.fill_grid(grid.dense_grid(base(t), "area_id", "year", 1995, 2001), counts(t), ["area_id", "year"], ["built"])
    shifted = grid_cells.select("area_id", (F.col("year") + 1).alias("year"), F.col("built").alias("again"))
    return quality.identity_gaps(treated(t).join(shifted, ["area_id", "year"]), ["built_lag1"], "again")


@query("q09_quality_summary", f"""WITH {PANEL} SELECT 'rate' AS variable, count(rate) AS n, round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS sd, round(min(rate), 6) AS min, round(max(rate), 6) AS max,
 round(quantile_cont(rate, 0.25), 6) AS p25, round(median(rate), 6) AS median, round(quantile_cont(rate, 0.75), 6) AS p75, count(*) - count(rate) AS n_missing FROM panel_all
 UNION ALL SELECT 'x', count(x), round(avg(x), 6), round(stddev_samp(x), 6), round(min(x), 6), round(max(x), 6), round(quantile_cont(x, 0.25), 6), round(median(x), 6), round(quantile_cont(x, 0.75), 6), count(*) - count(x) FROM panel_all""")
def q09(t):
    p = t.panel_all
    miss = quality.missingness(p, ["rate", "x"]).select("variable", "n_missing")
    return rounded(attach(profile.describe(p, ["rate", "x"]), miss, ["variable"]))


@query("o01_coverage_ratio", f"""WITH {TX}, fy AS (SELECT year, count(*) AS k FROM tx GROUP BY year), official AS (SELECT a.year, CAST(0.25 * a.k + 0.75 * b.k AS DOUBLE) AS calendar FROM fy a JOIN fy b ON b.year = a.year + 1)
SELECT o.year, round(calendar, 6) AS calendar, round(fy.k / calendar, 10) AS ratio FROM official o JOIN fy USING (year)""")
def o01(t):
    fy = t.tx.groupBy("year").agg(F.count(F.lit(1)).alias("k"))
    cal = profile.fiscal_to_calendar(fy, "year", "k", "calendar")
    return rounded(cal.select("year", "calendar", (F.col("k") / F.col("calendar")).alias("ratio")), 10, calendar=6)


@query("o02_build_difference", """WITH d AS (SELECT count(*) FILTER (WHERE c_custkey % 11 = 0) AS removed, count(*) FILTER (WHERE c_custkey % 11 <> 0 AND c_custkey % 5 = 0) AS bal, count(*) FILTER (WHERE c_custkey % 13 = 0) AS added FROM customer)
SELECT '(removed rows)' AS "column", removed AS n_changed FROM d UNION ALL SELECT '(added rows)', added FROM d UNION ALL SELECT 'c_acctbal', bal FROM d UNION ALL SELECT 'c_mktsegment', 0 FROM d""")
def o02(t):
    old = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    new = old.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    extra = old.where("c_custkey % 13 = 0").withColumn("c_custkey", -F.col("c_custkey") - 1)
    return quality.build_difference(old, new.unionByName(extra), ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@query("t01_global_order", f"WITH {TX} SELECT area_id, year, count(*) AS n FROM tx GROUP BY ALL ORDER BY area_id, year")
def t01(t):
    return t.tx.groupBy("area_id", "year").agg(F.count(F.lit(1)).alias("n")).orderBy("area_id", "year")


@query("t02_top_rows", f"WITH {PANEL} SELECT area_id, year, built FROM panel_all ORDER BY built DESC, area_id, year LIMIT 25")
def t02(t):
    return profile.top_rows(t.panel_all.select("area_id", "year", "built"), "built", ["area_id", "year"], 25)


@query("t03_upper_tail", f"""WITH {PANEL} SELECT q AS quantile, round(v, 6) AS value FROM (SELECT unnest([0.9, 0.95, 0.99, 0.999, 1.0]::DOUBLE[]) AS q,
 unnest(quantile_cont(rate, [0.9, 0.95, 0.99, 0.999, 1.0])) AS v FROM panel_all)""")
def t03(t):
    return rounded(profile.upper_tail(t.panel_all, "rate", [0.9, 0.95, 0.99, 0.999, 1.0]))
