"""Lookup joins, event de-duplication, forward lookups and match quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.catalog.base import AREAS, CERTS, TX, query, rounded
from terrapanel.operators import events, lookup
from terrapanel.operators.joins import attach, with_scalars


def half_lookup(t):
    """Supplier lookup missing every third key, with each row repeated: two hazards at once."""
    s = t.supplier.where("s_suppkey % 3 <> 0").select("s_suppkey", "s_nationkey")
    return s.unionByName(s)


@query("j01_left_lookup", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(s_nationkey AS BIGINT) AS s_nationkey,
 s_suppkey IS NOT NULL AS matched FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON l_suppkey = s_suppkey""")
def j01(t):
    lk = lookup.unique_lookup(half_lookup(t), ["s_suppkey", "s_nationkey"])
    facts = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    return lookup.lookup_join(facts, lk, "l_suppkey", "s_suppkey", "matched").select(
        "l_orderkey", "l_linenumber", "s_nationkey", "matched")


@query("j02_normalised_key", """SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE code IS NOT NULL) AS n_matched
 FROM part LEFT JOIN (SELECT DISTINCT upper(p_brand) AS code FROM part WHERE p_size > 49) k ON upper(trim(p_brand)) = code GROUP BY p_brand""")
def j02(t):
    codes = t.part.where("p_size > 49").select(F.upper("p_brand").alias("code")).distinct()
    messy = t.part.select("p_brand", F.concat(F.lit(" "), F.lower("p_brand")).alias("raw"))
    out = lookup.lookup_join(messy, codes, "raw", "code", "hit", normalise=True)
    return out.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_matched"))


@query("j03_two_hop_lookup", f"""WITH {TX}, {AREAS} SELECT r_name, year, count(*) AS n FROM tx LEFT JOIN areas USING (area_id)
 LEFT JOIN region ON region_id = r_regionkey GROUP BY ALL""")
def j03(t):
    areas = t.areas.select("area_id", "region_id")
    hop = lookup.lookup_join(t.tx.select("area_id", "year"), areas, "area_id")
    hop = lookup.lookup_join(hop, t.region, "region_id", "r_regionkey")
    return hop.groupBy("r_name", "year").agg(F.count(F.lit(1)).alias("n"))


@query("j04_lookup_dedup", "SELECT count(*) AS n_facts, count(*) AS n_joined, count(*) * 2 AS n_fanned_out FROM orders JOIN customer ON o_custkey = c_custkey")
def j04(t):
    double = t.customer.select("c_custkey").unionByName(t.customer.select("c_custkey"))
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    n = o.agg(F.count(F.lit(1)).alias("n_facts"))
    safe = o.join(lookup.unique_lookup(double, ["c_custkey"]), "c_custkey").agg(F.count(F.lit(1)).alias("n_joined"))
    fan = o.join(double, "c_custkey").agg(F.count(F.lit(1)).alias("n_fanned_out"))
    return with_scalars(with_scalars(n, safe), fan)


@query("j05_star_merge", f"""WITH {TX}, {AREAS}, s AS (SELECT area_id, year, count(*) AS n, round(sum(price), 2) AS total FROM tx GROUP BY ALL)
SELECT s.area_id, s.year, n, total, district_id, n_name, region_id, r_name, income FROM s LEFT JOIN areas a ON s.area_id = a.area_id
 LEFT JOIN nation ON district_id = n_nationkey LEFT JOIN region ON region_id = r_regionkey""")
def j05(t):
    s = t.tx.groupBy("area_id", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))
    from terrapanel.plans.final_panel import merge_star
    return merge_star(s, [(t.areas, ["area_id"]), (t.nation.select(F.col("n_nationkey").alias("district_id"), "n_name"), ["district_id"]),
                          (t.region.select(F.col("r_regionkey").alias("region_id"), "r_name"), ["region_id"])]).select(
        "area_id", "year", "n", "total", "district_id", "n_name", "region_id", "r_name", "income")


@query("j06_composite_key", f"""WITH {TX}, a AS (SELECT area_id, year, count(*) AS n_all FROM tx GROUP BY ALL),
b AS (SELECT area_id, year, count(*) AS n_returned FROM tx WHERE kind = 'R' GROUP BY ALL)
SELECT area_id, year, n_all, n_returned FROM a LEFT JOIN b USING (area_id, year)""")
def j06(t):
    a = t.tx.groupBy("area_id", "year").agg(F.count(F.lit(1)).alias("n_all"))
    b = t.tx.where("kind = 'R'").groupBy("area_id", "year").agg(F.count(F.lit(1)).alias("n_returned"))
    return attach(a, b, ["area_id", "year"])


@query("j11_side_indicator", """SELECT side, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only'
 ELSE 'both' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a
 FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k) GROUP BY side""")
def j11(t):
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return lookup.side_indicator(a, b, "k").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("j12_validated_join", "SELECT c_nationkey::BIGINT AS nation_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j12(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation_id"))
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return lookup.validated_join(o, c, ["c_custkey"], "m:1").groupBy("nation_id").agg(F.count(F.lit(1)).alias("n"))


@query("j13_semi_join", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def j13(t):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(keys, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("j14_nesting_check", """SELECT count(*) AS n_children, count(*) FILTER (WHERE lo <> hi) AS n_not_nested, count(*) FILTER (WHERE lo IS NULL) AS n_without_parent
 FROM (SELECT l_partkey, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem GROUP BY 1)""")
def j14(t):
    return lookup.nesting_report(t.lineitem, "l_partkey", "l_returnflag")


FIRSTS = f"""{CERTS}, firsts AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY dwelling_id
 ORDER BY lodged_on NULLS LAST, floor_area NULLS LAST, event_id) AS rn FROM certs WHERE kind = 'signup' AND dwelling_id IS NOT NULL
 AND lodged_on IS NOT NULL) WHERE rn = 1)"""


def firsts(t):
    return events.first_record(t.certs.where("kind = 'signup'"), "dwelling_id", ["lodged_on", "floor_area"], "event_id")


@query("w01_earliest_record", f"WITH {FIRSTS} SELECT dwelling_id, event_id, lodged_on, kind, floor_area FROM firsts")
def w01(t):
    return firsts(t)


LATER = """SELECT f.dwelling_id, f.lodged_on, e.kind, e.lodged_on AS d, row_number() OVER (PARTITION BY f.dwelling_id ORDER BY e.lodged_on, e.event_id) AS rn
 FROM firsts f JOIN certs e ON e.dwelling_id = f.dwelling_id AND e.lodged_on > f.lodged_on"""


@query("j15_forward_asof", f"""WITH {FIRSTS}, late AS ({LATER} WHERE e.kind IN ('purchase', 'error') AND e.floor_area > 120
 AND e.lodged_on <= f.lodged_on + INTERVAL 1 MONTH)
SELECT f.dwelling_id, f.lodged_on, l.kind AS next_kind, l.d AS next_on FROM firsts f LEFT JOIN late l ON f.dwelling_id = l.dwelling_id AND l.rn = 1""")
def j15(t):
    test = F.col("kind").isin("purchase", "error") & (F.col("floor_area") > 120)
    return events.next_record(firsts(t).select("dwelling_id", "lodged_on"), t.certs, "dwelling_id", "lodged_on", "lodged_on", "kind",
                              "event_id", "next_kind", "next_on", test, months=1)


@query("j16_conditional_fill", f"""WITH {FIRSTS}, late AS ({LATER} WHERE e.kind <> 'signup' AND e.lodged_on <= f.lodged_on + INTERVAL 24 MONTH)
SELECT filled, count(*) AS n FROM (SELECT CASE WHEN f.floor_area < 50 AND l.kind IS NOT NULL THEN l.kind WHEN f.floor_area < 50 THEN 'UNKNOWN' ELSE 'signup' END AS filled
 FROM firsts f LEFT JOIN late l ON f.dwelling_id = l.dwelling_id AND l.rn = 1) GROUP BY filled""")
def j16(t):
    f = firsts(t).withColumn("grp", F.when(F.col("floor_area") < 50, "UNKNOWN").otherwise(F.col("kind")))
    found = events.next_record(f, t.certs, "dwelling_id", "lodged_on", "lodged_on", "kind", "event_id", "next_kind", "next_on",
                               F.col("kind") != "signup", months=24)
    return events.fill_unknown(found, "grp", "next_kind", "UNKNOWN", "filled").groupBy("filled").agg(F.count(F.lit(1)).alias("n"))


@query("j17_next_event_gap", f"""WITH {CERTS}, days AS (SELECT dwelling_id, lodged_on, min_by(kind, event_id) AS kind FROM certs GROUP BY ALL),
nx AS (SELECT dwelling_id, lodged_on, lead(lodged_on) OVER w AS next_on, lead(kind) OVER w AS next_kind FROM days WINDOW w AS (PARTITION BY dwelling_id ORDER BY lodged_on))
SELECT event_id, next_kind, CAST(date_diff('day', lodged_on, next_on) AS BIGINT) AS days_to_next FROM certs JOIN nx USING (dwelling_id, lodged_on)""")
def j17(t):
    out = events.next_record(t.certs, t.certs, "dwelling_id", "lodged_on", "lodged_on", "kind", "event_id", "next_kind", "next_on")
    return out.select("event_id", "next_kind", F.date_diff("next_on", "lodged_on").alias("days_to_next"))


@query("a11_first_filtered", f"""WITH {CERTS} SELECT dwelling_id, min_by(kind, struct_pack(a := lodged_on, b := event_id)) FILTER (WHERE floor_area > 100) AS first_large_kind
 FROM certs GROUP BY dwelling_id""")
def a11(t):
    return events.first_where(t.certs, ["dwelling_id"], "kind", "lodged_on", "event_id", F.col("floor_area") > 100, "first_large_kind")


@query("o07_dedup_summary", f"""WITH c AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS k, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS d FROM events)
SELECT count(*) AS n_records, count(*) FILTER (WHERE k IS NULL) AS n_missing_key, count(*) FILTER (WHERE k IS NOT NULL AND d IS NULL) AS n_missing_date,
 count(DISTINCT CASE WHEN d IS NOT NULL THEN k END) AS n_unique, count(*) FILTER (WHERE k IS NOT NULL AND d IS NOT NULL) - count(DISTINCT CASE WHEN d IS NOT NULL THEN k END) AS n_collapsed FROM c""")
def o07(t):
    gaps = t.certs.select(F.when(F.col("event_id") % 10 != 0, F.col("dwelling_id")).alias("k"), F.when(F.col("event_id") % 7 != 0, F.col("lodged_on")).alias("d"))
    return events.dedup_summary(gaps, "k", "d")


@query("j27_crosswalk_share", """WITH p AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), k AS (SELECT src, count(*) AS k FROM p GROUP BY src)
SELECT dst, round(sum(p_retailprice / k), 5) AS share_weight FROM p JOIN k USING (src) JOIN part ON src = p_partkey GROUP BY dst""")
def j27(t):
    pieces = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("p_retailprice").alias("w"))
    return rounded(lookup.split_weight(pieces, "src", "dst", "w", "share_weight"), 5)


LINKS = """links AS (SELECT DISTINCT c_nationkey::BIGINT AS old, CASE WHEN c_nationkey < 5 THEN 0 WHEN c_nationkey = 7 AND c_acctbal > 0 THEN 107
 WHEN c_nationkey = 9 THEN 109 ELSE c_nationkey END::BIGINT AS new FROM customer)"""


def links(t):
    k = F.col("c_nationkey")
    new = (F.when(k < 5, 0).when((k == 7) & (F.col("c_acctbal") > 0), 107).when(k == 9, 109).otherwise(k))
    return t.customer.select(k.cast("long").alias("old"), new.cast("long").alias("new"))


@query("j28_vintage_link", f"""WITH {LINKS}, n AS (SELECT *, count(*) OVER (PARTITION BY old) AS n_new, count(*) OVER (PARTITION BY new) AS n_old FROM links)
SELECT count(*) AS n_links, count(*) FILTER (WHERE n_new = 1 AND n_old = 1 AND old = new) AS n_unchanged, count(*) FILTER (WHERE n_new > 1) AS n_in_split,
 count(*) FILTER (WHERE n_old > 1) AS n_in_merge FROM n""")
def j28(t):
    r = lookup.code_relationship(links(t), "old", "new")
    return r.agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("relationship") == "unchanged").alias("n_unchanged"),
                 F.count_if(F.col("n_new") > 1).alias("n_in_split"), F.count_if(F.col("n_old") > 1).alias("n_in_merge"))


@query("o05_code_relationship", f"""WITH {LINKS}, n AS (SELECT *, count(*) OVER (PARTITION BY old) AS n_new, count(*) OVER (PARTITION BY new) AS n_old FROM links)
SELECT old, new, n_new, n_old, CASE WHEN n_new = 1 AND n_old = 1 AND old = new THEN 'unchanged' WHEN n_new = 1 AND n_old = 1 THEN 'recoded'
 WHEN n_new > 1 AND n_old = 1 THEN 'split' WHEN n_new = 1 THEN 'merged' ELSE 'complex' END AS relationship FROM n""")
def o05(t):
    return lookup.code_relationship(links(t), "old", "new")


@query("a08_dimension_collapse", """WITH c AS (SELECT l_partkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_returnflag, l_linestatus FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag, l_linestatus) AS rn FROM c) WHERE rn = 1""")
def a08(t):
    return lookup.most_common_parent(t.lineitem, "l_partkey", ["l_returnflag", "l_linestatus"])


MATCH = """SELECT l_linestatus, year(l_shipdate)::BIGINT AS year, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS code FROM lineitem"""


def matched(t):
    return t.lineitem.select("l_linestatus", F.year("l_shipdate").alias("year"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).alias("code"))


@query("a22_match_rate", f"SELECT year, count(*) AS n_rows, count(code) AS n_matched, round(count(code) / count(*), 8) AS match_rate FROM ({MATCH}) GROUP BY year")
def a22(t):
    return rounded(lookup.match_rate(matched(t), "code", ["year"]), 8)


@query("o04_unmatched_by_category", f"SELECT l_linestatus, round(1 - count(code) / count(*), 8) AS unmatched_rate FROM ({MATCH}) GROUP BY 1")
def o04(t):
    return lookup.match_rate(matched(t), "code", ["l_linestatus"]).select("l_linestatus", F.round(1 - F.col("match_rate"), 8).alias("unmatched_rate"))


@query("q03_match_rate_floor", f"SELECT count(*) AS n_rows, round(count(code) / count(*), 8) AS match_rate FROM ({MATCH})")
def q03(t):
    lookup.require_match_rate(matched(t), "code", 0.6)
    return rounded(lookup.match_rate(matched(t), "code").select("n_rows", "match_rate"), 8)


@query("u04_universe_difference", """SELECT count(*) FILTER (WHERE b.k IS NULL) AS n_left_only, count(*) FILTER (WHERE a.k IS NULL) AS n_right_only,
 count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000) b ON a.k = b.k""")
def u04(t):
    return lookup.universe_difference(t.orders.select(F.col("o_custkey").alias("k")), t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), "k")


@query("u01_labelled_union", """SELECT 'F' AS label, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'P', count(*) FROM orders WHERE o_orderstatus = 'P'""")
def u01(t):
    parts = [t.orders.where(F.col("o_orderstatus") == v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("label"), "n") for v in ("F", "O", "P")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("u02_union_all", "SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u02(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).unionAll(t.supplier.select("s_nationkey"))


@query("u03_distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def u03(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("w15_share_within_group", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 10) AS share FROM lineitem GROUP BY 1, 2""")
def w15(t):
    c = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return rounded(lookup.share_within(c, "n", ["l_returnflag"], "share"), 10)
