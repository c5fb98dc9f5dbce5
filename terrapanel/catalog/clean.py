"""Projections, filters, funnels and trimming."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.catalog.base import PANEL, TX, query, rounded
from terrapanel.functions import expressions as X
from terrapanel.operators import clean
from terrapanel.plans.price_panel import price_panel

TENURE = {"PURCHASED": ["purchase", "Signup "], "BROWSED": ["view", "click"]}


@query("p01_lenient_cast", """SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 TRY_CAST(event_type AS BIGINT) AS bad_number, TRY_CAST(value AS BIGINT) IS NULL AS missing, event_id FROM events""")
def p01(t):
    ev = t.events.withColumn("k_text", F.get_json_object("props", "$.k"))
    out = clean.lenient_projection(ev, {"k": ("k_text", "bigint"), "bad_number": ("event_type", "bigint"),
                                        "v": ("value", "bigint"), "event_id": ("event_id", "bigint")})
    return out.select("k", "bad_number", F.col("v").isNull().alias("missing"), "event_id")


@query("p02_date_range", f"""WITH {TX} SELECT l_orderkey, l_linenumber, price FROM tx
 WHERE sold_on BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def p02(t):
    dates = t.lineitem.where(F.col("l_shipdate").between("1996-01-01", "1998-12-31"))
    return dates.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


@query("p03_category_if_present", f"""WITH {TX},
a AS (SELECT * FROM tx WHERE kind = 'A' OR NOT EXISTS (SELECT 1 FROM tx WHERE kind = 'A')),
z AS (SELECT * FROM a WHERE kind = 'Z' OR NOT EXISTS (SELECT 1 FROM a WHERE kind = 'Z'))
SELECT year, count(*) AS n FROM z GROUP BY year""")
def p03(t):
    a = clean.keep_category_if_present(t.tx.select("year", "kind"), "kind", "A")
    z = clean.keep_category_if_present(a, "kind", "Z")
    return z.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("p04_valid_measures", f"WITH {TX} SELECT l_orderkey, l_linenumber, price / size AS unit_price FROM tx WHERE price > 1000 AND size > 2")
def p04(t):
    ok = clean.valid_measures(t.tx, {"price": 1000.0, "size": 2.0})
    return ok.select("l_orderkey", "l_linenumber", (F.col("price") / F.col("size")).alias("unit_price"))


@query("p05_funnel", f"""WITH {TX}, c AS (SELECT count(*) AS a,
 count(*) FILTER (WHERE year BETWEEN 1996 AND 2000) AS b,
 count(*) FILTER (WHERE year BETWEEN 1996 AND 2000 AND kind <> 'R') AS c,
 count(*) FILTER (WHERE year BETWEEN 1996 AND 2000 AND kind <> 'R' AND size > 2) AS d FROM tx)
SELECT CAST(1 AS BIGINT) AS step_no, 'all' AS step, a AS rows FROM c UNION ALL SELECT 2, 'dated', b FROM c
UNION ALL SELECT 3, 'established', c FROM c UNION ALL SELECT 4, 'valid', d FROM c""")
def p05(t):
    return clean.funnel(t.tx, {"all": F.lit(True), "dated": F.col("year").between(1996, 2000),
                               "established": F.col("kind") != "R", "valid": F.col("size") > 2})


@query("p06_exclude", "SELECT * EXCLUDE (l_tax, l_discount) REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber) FROM lineitem")
def p06(t):
    return t.lineitem.drop("l_tax", "l_discount")


@query("p07_category_map", """SELECT event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 'PURCHASED'
 WHEN event_type IN ('view', 'click') THEN 'BROWSED' ELSE 'UNKNOWN' END AS tenure_group, count(*) AS n FROM events GROUP BY ALL""")
def p07(t):
    mapped = t.events.withColumn("tenure_group", X.category_of(F.col("event_type"), TENURE))
    return mapped.groupBy("event_type", "tenure_group").agg(F.count(F.lit(1)).alias("n"))


@query("p08_prefix_filter", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE p_type <> 'ECONOMY') AS n_disagree
 FROM part WHERE p_brand LIKE 'Brand#1%'""")
def p08(t):
    return t.part.where(F.col("p_brand").startswith("Brand#1")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("p_type") != "ECONOMY").alias("n_disagree"))


@query("p09_window_flags", f"""WITH {PANEL} SELECT area_id, year, year BETWEEN 1998 AND 2001 AS main_sample,
 base IS NOT NULL AND income IS NOT NULL AS baseline_complete,
 base IS NOT NULL AND income IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL AS analysis_complete_case FROM panel_all""")
def p09(t):
    out = clean.window_flags(t.panel_all, "year", 1998, 2001, ["base", "income"], ["y", "x"])
    return out.select("area_id", "year", "main_sample", "baseline_complete", "analysis_complete_case")


@query("p10_low_count_flags", f"""WITH {PANEL} SELECT area_id, year, n, CAST(n < 80 AS BIGINT) AS n_under_80,
 CAST(n < 90 AS BIGINT) AS n_under_90 FROM cells""")
def p10(t):
    return clean.low_count_flags(t.cells.select("area_id", "year", "n"), "n", [80, 90])


@query("p11_complete_cases", f"WITH {PANEL} SELECT area_id, year FROM panel_all WHERE x IS NOT NULL AND y IS NOT NULL")
def p11(t):
    return clean.complete_cases(t.panel_all, ["x", "y"]).select("area_id", "year")


@query("p12_estimation_sample", f"""WITH {PANEL} SELECT area_id, district_id, year FROM panel WHERE district_id IN
 (SELECT district_id FROM panel GROUP BY 1 HAVING count(DISTINCT area_id) >= 2)""")
def p12(t):
    return clean.groups_with_two(t.panel, "district_id", "area_id").select("area_id", "district_id", "year")


@query("p13_count_threshold", f"WITH {PANEL} SELECT area_id, year, n FROM cells WHERE n >= 85")
def p13(t):
    return t.cells.where("n >= 85").select("area_id", "year", "n")


@query("p14_winsorise_and_trim", f"""WITH {PANEL}, q AS (SELECT quantile_cont(rate, 0.9) AS q9 FROM panel_all)
SELECT year, round(avg(least(rate, q9)), 6) AS mean_winsorised, round(avg(rate) FILTER (WHERE rate <= q9), 6) AS mean_trimmed,
 count(*) FILTER (WHERE rate <= q9) AS n_kept FROM panel_all, q GROUP BY year""")
def p14(t):
    p = t.panel_all.select("year", "rate")
    wins = clean.winsorise(p, "rate", 0.9, "w").groupBy("year").agg(F.avg("w").alias("mean_winsorised"))
    trim = clean.trim_above(p, "rate", 0.9).groupBy("year").agg(
        F.avg("rate").alias("mean_trimmed"), F.count(F.lit(1)).alias("n_kept"))
    return rounded(wins.join(trim, "year"))


@query("p15_scalar_measures", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(ln(l_extendedprice / l_quantity), 8) AS log_unit,
 round(ln(1 + l_discount), 8) AS log1p_discount, round(1000.0 * l_tax / NULLIF(l_discount, 0), 6) AS tax_per_1000,
 round(l_quantity * 52, 6) AS annual_size, CASE WHEN l_tax > 0 THEN round(ln(l_tax), 8) END AS log_tax FROM lineitem""")
def p15(t):
    li = t.lineitem
    return li.select("l_orderkey", "l_linenumber", F.round(X.safe_ln(F.col("l_extendedprice") / F.col("l_quantity")), 8).alias("log_unit"),
                     F.round(F.log1p("l_discount"), 8).alias("log1p_discount"),
                     F.round(X.rate_per(F.col("l_tax"), F.col("l_discount")), 6).alias("tax_per_1000"),
                     F.round(F.col("l_quantity") * 52, 6).alias("annual_size"), F.round(X.safe_ln(F.col("l_tax")), 8).alias("log_tax"))


@query("p16_text_numbers", """SELECT o_orderkey, floor(o_totalprice) AS parsed FROM orders""")
def p16(t):
    text = F.concat(F.lit(" "), F.regexp_replace(F.format_number(F.floor("o_totalprice"), 0), "^,", ""), F.lit(" "))
    return t.orders.select("o_orderkey", X.number_from_text(text).alias("parsed"))


@query("p18_row_mean_sum", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((l_quantity + l_discount + l_tax) / 3.0, 8) AS composite,
 round(l_discount + l_tax, 8) AS band_sum FROM lineitem""")
def p18(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(X.row_mean(["l_quantity", "l_discount", "l_tax"]), 8).alias("composite"),
                             F.round(X.row_sum(["l_discount", "l_tax"]), 8).alias("band_sum"))


@query("p19_band_groups", """SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) / count(*) AS share_urgent,
 count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) / count(*) AS share_rest, count(*) AS total FROM orders GROUP BY o_custkey""")
def p19(t):
    from terrapanel.operators.indexing import grouped_shares, long_to_wide
    bands = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = long_to_wide(t.orders.withColumn("one", F.lit(1)), "o_custkey", "o_orderpriority", "one", {b: f"b{b[0]}" for b in bands})
    return grouped_shares(wide, {"urgent": ["b1", "b2"], "rest": ["b3", "b4", "b5"]}, "share_", "total").select(
        "o_custkey", "share_urgent", "share_rest", F.col("total").cast("long").alias("total"))


@query("p20_interactions", f"""WITH {PANEL} SELECT area_id, year, round(x * income, 4) AS x_income, round(x * n, 4) AS x_n FROM panel""")
def p20(t):
    from terrapanel.operators.indexing import interactions
    return rounded(interactions(t.panel, "x", ["income", "n"]).select("area_id", "year", "x_income", "x_n"), 4)


@query("p21_composite_keys", f"""WITH {PANEL} SELECT concat_ws('_', district_id, year) AS district_year, count(*) AS n_areas FROM panel GROUP BY 1""")
def p21(t):
    return t.panel.groupBy(F.concat_ws("_", "district_id", "year").alias("district_year")).agg(F.count(F.lit(1)).alias("n_areas"))


@query("p22_grid_snap", """SELECT CAST(floor(c_acctbal / 100) * 100 AS DOUBLE) AS cell, count(*) AS n FROM customer GROUP BY 1""")
def p22(t):
    return t.customer.groupBy(X.snap(F.col("c_acctbal"), 100.0).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("p23_size_bands", """SELECT CASE WHEN p_size <= 1 THEN '1' WHEN p_size <= 9 THEN '2-9' WHEN p_size <= 24 THEN '10-24' ELSE '25+' END AS size_band,
 count(*) AS n FROM part GROUP BY 1""")
def p23(t):
    b = X.band(F.col("p_size"), [(1, "1"), (9, "2-9"), (24, "10-24")], "25+")
    return t.part.groupBy(b.alias("size_band")).agg(F.count(F.lit(1)).alias("n"))


@query("p24_column_selection", """SELECT 'p_size' AS variable, count(DISTINCT p_size) AS n_distinct FROM part UNION ALL
 SELECT 'p_retailprice', count(DISTINCT p_retailprice) FROM part UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey) FROM part""")
def p24(t):
    return clean.distinct_counts(t.part, clean.numeric_columns(t.part)).where("n_distinct > 2")


@query("j07_trim_bounds", f"""WITH {TX}, u AS (SELECT year, price / size AS unit FROM tx),
b AS (SELECT year, quantile_cont(unit, 0.005) AS lo, quantile_cont(unit, 0.995) AS hi FROM u GROUP BY year)
SELECT year, count(*) AS n_kept, round(min(unit), 6) AS lowest, round(max(unit), 6) AS highest
 FROM u JOIN b USING (year) WHERE unit BETWEEN lo AND hi GROUP BY year""")
def j07(t):
    u = t.tx.select("year", (F.col("price") / F.col("size")).alias("unit"))
    kept = clean.trim_within(u, ["year"], "unit", 0.005, 0.995)
    return rounded(kept.groupBy("year").agg(F.count(F.lit(1)).alias("n_kept"), F.min("unit").alias("lowest"), F.max("unit").alias("highest")))


@query("j08_deflator", f"""WITH {TX}, cpi AS (SELECT year, month, 100.0 + 3 * (year - 1995) + 0.25 * month AS idx FROM
 (SELECT DISTINCT year, month FROM tx WHERE NOT (year = 1996 AND month = 7)))
SELECT tx.year, round(avg(price / (idx / 100.0)), 4) AS mean_real_price, count(*) FILTER (WHERE idx IS NULL) AS n_unmatched
 FROM tx LEFT JOIN cpi ON tx.year = cpi.year AND tx.month = cpi.month GROUP BY tx.year""")
def j08(t):
    cpi = (t.tx.select("year", "month").distinct().where("NOT (year = 1996 AND month = 7)")
           .withColumn("idx", F.lit(100.0) + 3 * (F.col("year") - 1995) + F.lit(0.25) * F.col("month")))
    real = clean.deflate(t.tx, cpi, ["year", "month"], "idx", "price", "real_price")
    return rounded(real.groupBy("year").agg(F.avg("real_price").alias("mean_real_price"),
                                            F.count_if(F.col("real_price").isNull()).alias("n_unmatched")), 4)


PRICE_PANEL_SQL = f"""WITH {TX}, v AS (SELECT area_id, year, price, size, kind, status, price / size AS unit FROM tx WHERE price > 0 AND size > 0
 AND sold_on BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND kind <> 'R'),
b AS (SELECT year, quantile_cont(unit, 0.005) AS lo, quantile_cont(unit, 0.995) AS hi FROM v GROUP BY year),
k AS (SELECT v.* FROM v JOIN b ON v.year = b.year WHERE unit BETWEEN lo AND hi)
SELECT area_id, year, count(*) AS sale_count, round(median(price), 7) AS median_price, round(median(unit), 7) AS median_unit,
 round(avg(unit), 6) AS mean_unit, round(avg(ln(unit)), 8) AS mean_log_unit, round(quantile_cont(unit, 0.25), 7) AS p25_unit,
 round(quantile_cont(unit, 0.75), 7) AS p75_unit, round(median(size), 7) AS median_size, round(ln(median(unit)), 8) AS log_median_unit,
 round(count(*) FILTER (WHERE kind = 'A') / count(*), 8) AS a_share, round(count(*) FILTER (WHERE status = 'F') / count(*), 8) AS f_share,
 CAST(count(*) < 40 AS BIGINT) AS sale_count_under_40, CAST(count(*) < 50 AS BIGINT) AS sale_count_under_50 FROM k GROUP BY area_id, year"""


@query("a02_panel_aggregate", PRICE_PANEL_SQL)
def a02(t):
    return rounded(price_panel(t.tx), 6, median_price=7, median_unit=7, p25_unit=7, p75_unit=7,
                   median_size=7, mean_log_unit=8, log_median_unit=8, a_share=8, f_share=8)
