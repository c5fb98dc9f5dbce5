"""Attributes, weighted roll-ups and composite indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.catalog.base import PANEL, TX, query, rounded
from terrapanel.functions import expressions as X
from terrapanel.operators import indexing, profile
from terrapanel.operators.joins import attach, with_scalars

# small areas: customers with two scores and two populations; parents: nations
SMALL = """sm AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS parent, c_acctbal AS s1, coalesce(k, 0)::DOUBLE AS s2, coalesce(v, 0) AS s3,
 coalesce(k, 0) + 1 AS pop, coalesce(f, 0) + 1 AS pop_work FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
 max(o_totalprice) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def small(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.max("o_totalprice").alias("v"))
    c = attach(t.customer, o, ["c_custkey"])
    zero = F.lit(0)
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("parent"), F.col("c_acctbal").alias("s1"),
                    F.coalesce("k", zero).cast("double").alias("s2"), F.coalesce("v", F.lit(0.0)).alias("s3"),
                    (F.coalesce("k", zero) + 1).alias("pop"), (F.coalesce("f", zero) + 1).alias("pop_work"))


@query("a09_long_to_wide", """SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1""")
def a09(t):
    o = t.orders.withColumn("one", F.lit(1).cast("long"))
    return indexing.long_to_wide(o, "o_custkey", "o_orderpriority", "one", {"1-URGENT": "urgent", "5-LOW": "low"})


@query("a10_pivot_sum", """SELECT c_nationkey::BIGINT AS nation_id, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS F, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS O FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def a10(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    p = j.groupBy(F.col("c_nationkey").alias("nation_id")).pivot("o_orderstatus", ["F", "O"]).agg(F.sum("o_totalprice"))
    return rounded(p.fillna(0.0), 2)


@query("a12_weighted_mean", f"WITH {SMALL} SELECT parent, round(sum(s1 * pop) / sum(pop), 6) AS s1_w FROM sm GROUP BY parent")
def a12(t):
    return rounded(indexing.weighted_rollup(small(t), "parent", [("s1_w", "s1", "pop")]))


@query("a13_weighted_share", f"WITH {SMALL} SELECT parent, round(coalesce(sum(pop) FILTER (WHERE s1 < 2000), 0) / sum(pop), 10) AS share_low FROM sm GROUP BY parent")
def a13(t):
    return rounded(indexing.weighted_share(small(t), "parent", F.col("s1") < 2000, "pop", "share_low"), 10)


@query("a14_weighting_sensitivity", f"WITH {SMALL}, m AS (SELECT sum(s1 * pop) / sum(pop) AS a, avg(s1) AS b FROM sm GROUP BY parent) SELECT count(*) AS n_groups, round(max(abs(a - b)), 6) AS max_abs_diff, round(corr(a, b), 8) AS correlation FROM m")
def a14(t):
    return rounded(indexing.weighting_sensitivity(small(t), "parent", "s1", "pop"), 6, correlation=8)


RANKED = f"""{SMALL}, r AS (SELECT *, rank() OVER (ORDER BY s1 DESC) AS r1, rank() OVER (ORDER BY s2 DESC) AS r2, rank() OVER (ORDER BY s3 DESC) AS r3, count(*) OVER () AS n FROM sm),
x AS (SELECT *, -23 * ln(1 - (n - r1 + 1.0::DOUBLE) / n * (1 - exp(-100.0::DOUBLE / 23))) AS x1, -23 * ln(1 - (n - r2 + 1.0::DOUBLE) / n * (1 - exp(-100.0::DOUBLE / 23))) AS x2, -23 * ln(1 - (n - r3 + 1.0::DOUBLE) / n * (1 - exp(-100.0::DOUBLE / 23))) AS x3 FROM r)"""


def transformed(t):
    r = indexing.rank_domains(small(t), ["s1", "s2", "s3"], "id")
    return indexing.transformed_domains(r, "id", ["s1", "s2", "s3"])


@query("d01_scaled_rank", f"WITH {RANKED} SELECT id, 's1' AS domain, r1 AS rank, round((n - r1 + 1.0::DOUBLE) / n, 10) AS share FROM r UNION ALL SELECT id, 's2', r2, round((n - r2 + 1.0::DOUBLE) / n, 10) FROM r")
def d01(t):
    r = indexing.rank_domains(small(t), ["s1", "s2"], "id")
    return rounded(r.select("id", "domain", "rank", X.scaled_rank(F.col("rank"), F.col("n")).alias("share")), 10)


@query("d02_exponential_transform", f"WITH {RANKED} SELECT id, round(x1, 8) AS s1, round(x2, 8) AS s2, round(x3, 8) AS s3 FROM x")
def d02(t):
    return rounded(transformed(t), 8)


@query("d03_published_ranks", f"WITH {RANKED} SELECT id, 's1' AS domain, r1::DOUBLE AS rank, n FROM r UNION ALL SELECT id, 's2', r2::DOUBLE, n FROM r UNION ALL SELECT id, 's3', r3::DOUBLE, n FROM r")
def d03(t):
    s = small(t)
    domains, pub = ["s1", "s2", "s3"], s
    for d in domains:
        pub = pub.join(indexing.rank_domains(s, [d], "id").select("id", F.col("rank").alias(f"{d}_rank")), "id")
    return indexing.rank_domains(pub, domains, "id", "published", {d: f"{d}_rank" for d in domains})


WEIGHTS = {"s1": 0.5, "s2": 0.3, "s3": 0.199}


@query("d04_weighted_blend", f"WITH {RANKED} SELECT id, round(0.5 * x1 + 0.3 * x2 + 0.199 * x3, 7) AS full_index, round((0.5 * x1 + 0.3 * x2) / 0.8, 7) AS reduced FROM x")
def d04(t):
    b = indexing.blends(transformed(t), {"full_index": (WEIGHTS, False), "reduced": ({k: WEIGHTS[k] for k in ("s1", "s2")}, True)})
    return rounded(b.select("id", "full_index", "reduced"), 7)


@query("d05_parent_rollup", f"WITH {SMALL} SELECT parent, round(sum(s1 * pop) / sum(pop), 5) AS a, round(sum(s2 * pop_work) / sum(pop_work), 7) AS b, round(sum(s3 * pop) / sum(pop), 2) AS c FROM sm GROUP BY parent")
def d05(t):
    return rounded(indexing.weighted_rollup(small(t), "parent", [("a", "s1", "pop"), ("b", "s2", "pop_work"), ("c", "s3", "pop")]), 5, b=7, c=2)


@query("d06_reproduction", f"""WITH {SMALL}, g AS (SELECT s1 AS a, floor(s1 / 10) * 10 AS b FROM sm), r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM g)
SELECT count(*) AS n, round(corr(a, b), 9) AS pearson, round(corr(ra, rb), 9) AS spearman, round(max(abs(a - b)), 7) AS max_abs_diff, round(avg(abs(a - b)), 7) AS mean_abs_diff, round(avg((a = b)::INT), 9) AS share_identical FROM r""")
def d06(t):
    g = small(t).withColumn("s1r", X.snap(F.col("s1"), 10.0))
    indexing.require_agreement(g, "s1", "s1r", 0.99, 10.0)
    return rounded(indexing.agreement(g, "s1", "s1r"), 7, pearson=9, spearman=9, share_identical=9)


@query("d07_rank_source_agreement", f"WITH {RANKED}, d AS (SELECT r2 AS a, row_number() OVER (ORDER BY s2 DESC, id) AS b FROM r) SELECT count(*) AS n, round(avg((a = b)::INT), 9) AS share_identical, max(abs(a - b))::DOUBLE AS max_gap FROM d")
def d07(t):
    from terrapanel.operators.ranks import with_row_numbers
    from terrapanel.operators.quantiles import with_value_ranks
    r = with_row_numbers(with_value_ranks(small(t), [], "s2", descending=True), [], [F.col("s2").desc(), F.col("id").asc()])
    return rounded(indexing.agreement(r, "rank_min", "row_num").select("n", "share_identical", F.col("max_abs_diff").alias("max_gap")), 9)


@query("d08_recomputation", f"WITH {SMALL} SELECT count(DISTINCT parent) AS n_groups, true AS agrees FROM sm")
def d08(t):
    s = small(t)
    a = indexing.weighted_rollup(s, "parent", [("a", "s1", "pop")])
    b = s.groupBy("parent").agg((F.sum(F.col("s1") * F.col("pop")) / F.sum("pop")).alias("b"))
    return a.join(b, "parent").agg(F.count(F.lit(1)).alias("n_groups"), (F.max(F.abs(F.col("a") - F.col("b"))) < 1e-9).alias("agrees"))


@query("d10_moderators", f"""WITH {SMALL}, q AS (SELECT *, CAST(ceil(row_number() OVER (ORDER BY s1, id) * 4.0 / count(*) OVER ()) AS BIGINT) AS q, median(s1) OVER () AS med FROM sm)
SELECT id, round((s1 - avg(s1) OVER ()) / stddev_samp(s1) OVER (), 8) AS inc_z, q AS inc_quartile, CAST(q = 1 AS BIGINT) AS inc_poor, CAST(s1 < med AS BIGINT) AS inc_poor_half, 'higher = richer' AS inc_direction FROM q""")
def d10(t):
    m = indexing.build_moderators(small(t), "id", "s1", "inc", high_is_poor=False)
    return rounded(m.select("id", "inc_z", "inc_quartile", "inc_poor", "inc_poor_half", "inc_direction"), 8)


@query("d10_moderators_sign_switch", f"""WITH {SMALL}, q AS (SELECT *, CAST(ceil(row_number() OVER (ORDER BY s1, id) * 4.0 / count(*) OVER ()) AS BIGINT) AS q, median(s1) OVER () AS med FROM sm)
SELECT id, CAST(q = 4 AS BIGINT) AS dep_poor, CAST(s1 > med AS BIGINT) AS dep_poor_half, 'higher = more deprived' AS dep_direction FROM q""")
def d10b(t):
    m = indexing.build_moderators(small(t), "id", "s1", "dep", high_is_poor=True)
    return m.select("id", "dep_poor", "dep_poor_half", "dep_direction")


@query("d11_equal_weight_composite", f"WITH {RANKED}, c AS (SELECT parent, pop, (x1 + x2 + x3) / 3.0 AS c3, (x1 + x2) / 2.0 AS c2 FROM x) SELECT parent, round(avg(c3), 7) AS all_three, round(avg(c2), 7) AS subset, round(sum(c3 * pop) / sum(pop), 7) AS weighted FROM c GROUP BY parent")
def d11(t):
    c = transformed(t).join(small(t).select("id", "parent", "pop"), "id").withColumns({"c3": X.row_mean(["s1", "s2", "s3"]), "c2": X.row_mean(["s1", "s2"])})
    plain = c.groupBy("parent").agg(F.avg("c3").alias("all_three"), F.avg("c2").alias("subset"))
    return rounded(plain.join(indexing.weighted_rollup(c, "parent", [("weighted", "c3", "pop")]), "parent"), 7)


@query("d12_persistence", f"""WITH {PANEL}, l AS (SELECT area_id, max(region_id) % 2 AS stratum, max(rate) FILTER (WHERE year = 1995) AS o, max(rate) FILTER (WHERE year = 2001) AS w FROM panel_all GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY o) + (count(*) OVER (PARTITION BY stratum, o) - 1) / 2.0 AS ro, rank() OVER (PARTITION BY stratum ORDER BY w) + (count(*) OVER (PARTITION BY stratum, w) - 1) / 2.0 AS rw,
 row_number() OVER (PARTITION BY stratum ORDER BY o, area_id) AS no, row_number() OVER (PARTITION BY stratum ORDER BY w, area_id) AS nw, count(*) OVER (PARTITION BY stratum) AS n FROM l),
q AS (SELECT *, greatest(1, ceil((no - 1) / ((n - 1) / 4.0))) AS qo, greatest(1, ceil((nw - 1) / ((n - 1) / 4.0))) AS qw FROM r)
SELECT stratum, count(*) AS n, round(corr(o, w), 8) AS pearson, round(corr(ro, rw), 8) AS spearman, round(avg(abs(ro - rw) / n), 8) AS mean_abs_percentile_change, round(avg((qo = qw)::INT), 8) AS same_quartile, round(avg((abs(qo - qw) >= 2)::INT), 8) AS moved_two_or_more FROM q GROUP BY stratum""")
def d12(t):
    w = t.panel_all.groupBy("area_id").agg((F.max("region_id") % 2).cast("long").alias("stratum"), F.max(F.when(F.col("year") == 1995, F.col("rate"))).alias("o"), F.max(F.when(F.col("year") == 2001, F.col("rate"))).alias("w"))
    return rounded(indexing.persistence(w, "area_id", "o", "w", ["stratum"]), 8)


@query("d13_density_attributes", f"WITH {SMALL} SELECT parent, round(sum(pop) / count(*)::DOUBLE, 8) AS population_density, round(ln(sum(pop) / count(*)::DOUBLE), 8) AS log_population_density, round(sum(pop_work) / count(*)::DOUBLE, 8) AS household_density FROM sm GROUP BY parent")
def d13(t):
    g = small(t).groupBy("parent").agg(F.sum("pop").alias("p"), F.sum("pop_work").alias("h"), F.count(F.lit(1)).alias("ha"))
    return rounded(indexing.density_attributes(g, "p", "h", "ha").drop("p", "h", "ha"), 8)


@query("d14_decile_agreement", f"""WITH {SMALL}, d AS (SELECT parent, pop, CAST(ceil(10.0 * rank() OVER (ORDER BY s1 DESC) / count(*) OVER ()) AS BIGINT) AS dec, ntile(10) OVER (ORDER BY s1 DESC, id) AS pub FROM sm)
SELECT round(avg((dec = pub)::INT), 8) AS share_agreeing, count(*) FILTER (WHERE dec <= 2) AS n_bottom, (SELECT round(avg((k = 0)::INT), 8) FROM (SELECT count(*) FILTER (WHERE dec <= 1) AS k FROM d GROUP BY parent)) AS share_groups_without FROM d""")
def d14(t):
    from terrapanel.operators.ranks import ntile_of, with_row_numbers
    d = indexing.add_decile(small(t), "s1", "dec")
    d = with_row_numbers(d, [], [F.col("s1").desc(), F.col("id").asc()]).withColumn("pub", ntile_of(F.col("row_num"), F.col("group_n"), 10))
    per = profile.conditional_zero_share(d, ["parent"], F.col("dec") <= 1).select(F.col("share_zero").alias("share_groups_without"))
    a = d.agg(F.avg((F.col("dec") == F.col("pub")).cast("double")).alias("share_agreeing"), F.count_if(F.col("dec") <= 2).alias("n_bottom"))
    return rounded(with_scalars(a, per), 8)
