"""Literal fixtures: NULL semantics, unknown categories, fan-out, undefined versus zero, error contracts."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.functions import expressions as X
from terrapanel.operators import clean, edges, events, indexing, lookup, profile, quality
from terrapanel.sources import readers


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_invalid_measures_are_dropped(spark):
    df = spark.createDataFrame([(100.0, 50.0), (0.0, 50.0), (100.0, 0.0), (100.0, None), (-5.0, 10.0)], "p double, s double")
    assert rows(clean.valid_measures(df, {"p": 0.0, "s": 0.0}), "p", "s") == [(100.0, 50.0)]


def test_trim_bounds_stay_in_their_year(spark):
    df = spark.createDataFrame([(2012, float(100 + i)) for i in range(100)] + [(2013, float(10000 + i)) for i in range(100)], "year int, v double")
    kept = clean.trim_within(df, ["year"], "v", 0.005, 0.995).groupBy("year").agg(F.min("v"), F.max("v"), F.count("v"))
    assert sorted(tuple(r) for r in kept.collect()) == [(2012, 101.0, 198.0, 98), (2013, 10001.0, 10098.0, 98)]


def test_category_filter_passes_through_when_absent(spark):
    df = spark.createDataFrame([("B",), (None,)], "c string")
    assert clean.keep_category_if_present(df, "c", "A").count() == 2
    assert clean.keep_category_if_present(df, "c", "B").count() == 1


def test_unlisted_category_is_unknown(spark):
    groups = {"SOCIAL": ["rented (social)"], "OTHER": ["owner-occupied"]}
    df = spark.createDataFrame([("Rented (Social) ",), ("owner-occupied",), ("not defined",), (None,)], "c string")
    got = [r.g for r in df.select(X.category_of(F.col("c"), groups).alias("g")).collect()]
    assert got == ["SOCIAL", "OTHER", "UNKNOWN", "UNKNOWN"]


def test_first_record_ignores_missing_keys_and_breaks_ties(spark):
    d = dt.date
    df = spark.createDataFrame([(1, d(2015, 2, 1), None, 3), (1, d(2014, 1, 1), None, 2), (1, d(2014, 1, 1), d(2013, 1, 1), 9), (None, d(2010, 1, 1), None, 4), (2, None, None, 5)],
                               "id int, a date, b date, k int")
    assert rows(events.first_record(df, "id", ["a", "b"], "k"), "id", "a", "k") == [(1, d(2014, 1, 1), 9)]


def test_forward_lookup_is_strict_and_bounded(spark):
    d = dt.date
    ev = spark.createDataFrame([(1, d(2015, 1, 1)), (2, d(2015, 1, 1)), (3, d(2015, 1, 1))], "id int, on date")
    later = spark.createDataFrame([(1, d(2015, 1, 1), "same", 1), (1, d(2016, 6, 1), "b", 2), (1, d(2016, 6, 1), "a", 3), (2, d(2017, 1, 1), "edge", 4), (3, d(2017, 1, 2), "late", 5)], "id int, d date, v string, k int")
    out = events.next_record(ev, later, "id", "on", "d", "v", "k", "nxt", "nxt_on", months=24)
    assert rows(out, "id", "nxt") == [(1, "b"), (2, "edge"), (3, None)]


def test_lookup_fan_out_and_dedup(spark):
    facts = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    lk = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B")], "id int, code string")
    assert lookup.lookup_join(facts, lk, "id").count() == 4
    safe = lookup.lookup_join(facts, lookup.unique_lookup(lk, ["id", "code"]), "id", matched="hit")
    assert {r.id: (r.code, r.hit) for r in safe.collect()} == {1: ("A", True), 2: ("B", True), 3: (None, False)}
    with pytest.raises(ValueError):
        lookup.validated_join(facts, lk, ["id"])
    with pytest.raises(ValueError):
        lookup.require_match_rate(safe, "code", 0.9)
    assert lookup.require_match_rate(safe, "code", 0.6) == pytest.approx(2 / 3)


def test_normalised_key(spark):
    facts = spark.createDataFrame([(" ab1 2cd",), ("AB1 2CD ",), ("zz",)], "p string")
    lk = spark.createDataFrame([("AB1 2CD", "X")], "p string, m string").withColumnRenamed("p", "code")
    assert lookup.lookup_join(facts, lk, "p", "code", normalise=True).where("m = 'X'").count() == 2


def test_weighted_rollup_and_zero_weight(spark):
    df = spark.createDataFrame([("a", 0.1, 900.0, 10.0), ("a", 0.5, 100.0, 30.0)], "m string, v double, w double, w2 double")
    r = indexing.weighted_rollup(df, "m", [("x", "v", "w"), ("y", "v", "w2")]).first()
    assert r.x == pytest.approx(0.14) and r.y == pytest.approx(0.4)
    with pytest.raises(Exception, match="non-positive weight"):
        indexing.weighted_rollup(df.withColumn("w", F.lit(0.0)), "m", [("x", "v", "w")]).collect()


def test_exponential_score_endpoints_and_monotone(spark):
    n = 500
    df = spark.range(1, n + 1).select("id", X.exponential_score(X.scaled_rank(F.col("id"), F.lit(n))).alias("s")).orderBy("id")
    s = [r.s for r in df.collect()]
    assert s[0] == pytest.approx(100.0) and s == sorted(s, reverse=True) and 0 < s[-1] < 1


def test_moderator_flags_keep_their_meaning(spark):
    df = spark.range(8).withColumn("v", F.col("id") * 1.0)
    rich = indexing.build_moderators(df, "id", "v", "m", high_is_poor=False)
    poor = indexing.build_moderators(df, "id", "v", "m", high_is_poor=True)
    assert rows(rich.where("m_poor = 1"), "id") == [(0,), (1,)]
    assert rows(poor.where("m_poor = 1"), "id") == [(6,), (7,)]
    z = rich.agg(F.avg("m_z").alias("m"), F.stddev_samp("m_z").alias("s")).first()
    assert abs(z.m) < 1e-12 and z.s == pytest.approx(1.0)


def star(spark):
    """A hub 7 with the leaves 2, 4 and 9, a pendant 11 on leaf 9, and 20 on its own."""
    one_way = [(7, 2), (7, 4), (7, 9), (9, 11)]
    e = spark.createDataFrame(one_way + [(b, a) for a, b in one_way], "src int, dst int")
    households = {2: 50.0, 4: 150.0, 7: 400.0, 9: 250.0, 11: 80.0, 20: 10.0}
    v = spark.createDataFrame([(i, y, float(i + y), h) for i, h in households.items() for y in (1, 2)], "i int, y int, c double, h double")
    return e, v


def test_pooled_rate_is_a_ratio_of_sums_and_undefined_without_neighbours(spark):
    e, v = star(spark)
    out = edges.neighbour_aggregate(e, v, "i", "y", {"rate": edges.pooled_rate("c", "h"), "mean": edges.neighbour_mean("c")})
    got = {(r.i, r.y): r for r in out.collect()}
    assert got[(2, 1)].rate == pytest.approx(1000 * 8 / 400)
    assert got[(7, 1)].rate == pytest.approx(1000 * (3 + 5 + 10) / 450)
    assert got[(7, 2)].mean == pytest.approx((4 + 6 + 11) / 3)
    assert got[(20, 1)].rate is None and len(got) == 12


def test_neighbour_price_skips_missing_and_zero_sales(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "src int, dst int")
    v = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 10.0), (2, None, 50.0), (3, 9.0, 0.0)], "i int, p double, s double")
    r = {x.i: x for x in edges.neighbour_aggregate(e, v, "i", None, edges.sale_weighted("p", "s")).collect()}[0]
    assert (r["mean"], r.n_valid, r.total_sales) == (5.0, 1, 10.0)


def test_log_of_mean_is_not_mean_of_logs(spark):
    e = spark.createDataFrame([(0, 1), (0, 2)], "src int, dst int")
    v = spark.createDataFrame([(0, 1.0, 1.0), (1, 100.0, 1.0), (2, 10000.0, 1.0)], "i int, inc double, h double")
    r = {x.i: x for x in edges.neighbour_aggregate(e, v, "i", None, {"m": edges.weighted_level("inc", "h")}).collect()}[0]
    assert math.log(r.m) == pytest.approx(math.log(5050)) and math.log(r.m) != pytest.approx((math.log(100) + math.log(10000)) / 2)


def test_edge_contracts(spark):
    with pytest.raises(ValueError, match="own neighbour"):
        edges.validate_edges(spark.createDataFrame([(1, 1)], "src int, dst int"))
    with pytest.raises(ValueError, match="duplicated"):
        edges.validate_edges(spark.createDataFrame([(1, 2), (1, 2)], "src int, dst int"))
    e, _ = star(spark)
    assert rows(edges.second_order(e), "src", "dst") == sorted([(2, 4), (4, 2), (2, 9), (9, 2), (4, 9), (9, 4), (7, 11), (11, 7)])


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, None), (2, 7.0)], "k int, v double")
    assert rows(quality.varying_attributes(df, "k", ["v"]), "n_entities_varying") == [(1,)]
    assert quality.drop_exact_duplicates(df.where("k = 1"), ["k"]).count() == 1
    with pytest.raises(ValueError, match="conflicting"):
        quality.drop_exact_duplicates(df, ["k"])
    with pytest.raises(ValueError, match="rules violated"):
        quality.require(df, {"present": F.col("v").isNotNull()})
    with pytest.raises(ValueError):
        quality.require_counts(df, 5, {"k": 2})
    inf = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,), (None,)], "v double")
    assert quality.violations(inf, {"r": quality.in_range("v", 0)}).first().n_violations == 2


def test_modal_share_detects_a_failed_merge(spark):
    good = spark.range(1000).withColumn("v", F.col("id") % 400)
    bad = spark.range(1000).withColumn("v", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")))
    assert profile.modal_share(good, "v").first().top_share < 0.2 < profile.modal_share(bad, "v").first().top_share


def test_bands_must_partition(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    r = indexing.grouped_shares(df, {"young": ["a", "b"], "old": ["c"]}, "s_", "t").first()
    assert (r.s_young, r.s_old, r.t) == (0.5, 0.5, 6)
    with pytest.raises(ValueError):
        indexing.grouped_shares(df, {"x": ["a"], "y": ["a", "b"]}, "s_", "t")


def test_text_numbers_and_headers(spark):
    df = spark.createDataFrame([("1,680",), (" 920 ",), ("5",)], "t string")
    assert [r[0] for r in df.select(X.number_from_text(F.col("t"))).collect()] == [1680.0, 920.0, 5.0]
    with pytest.raises(Exception):
        spark.createDataFrame([("n/a",)], "t string").select(X.number_from_text(F.col("t"))).collect()
    assert readers.columns_for(["a (1)", "b"], {"first": "a*", "second": "b"}) == {"first": "a (1)", "second": "b"}
    with pytest.raises(KeyError, match="x\\*.*x1.*x2.*'c': \\[\\]"):
        readers.columns_for(["x1", "x2"], {"many": "x*", "none": "c", "one": "x1"})


def test_domain_rank_source_is_checked(spark):
    with pytest.raises(ValueError):
        indexing.rank_domains(spark.range(3).withColumn("s", F.lit(1.0)), ["s"], "id", "guess")


def test_large_collections_are_split(spark, tmp_path):
    """One collection of many features: several tasks, the same rows as by whole files; a file of another form stops the read."""
    import json

    from terrapanel.sources import readers
    features = [{"type": "Feature", "properties": {"CODE": f"a{i}", "note": "x" * 200, "more": {"type": "Features"}}, "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i, 1.5]]]}} for i in range(4000)]
    path = tmp_path / "c"
    path.mkdir()
    (path / "one.json").write_text(json.dumps({"type": "FeatureCollection", "name": "n", "features": features, "after": {"geometry": 1}}))
    (path / "two.json").write_text(json.dumps({"type": "FeatureCollection", "features": features[:3]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        split = readers.geojson(spark, str(path), "CODE", start='{"type": "Feature",')
        tasks = split.select(F.spark_partition_id().alias("p")).distinct().count()
        rows = sorted(split.select("code", "kind", F.to_json("rings").alias("rings")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks >= 8 and rows == sorted(readers.geojson(spark, str(path), "CODE").select("code", "kind", F.to_json("rings").alias("rings")).collect()) and len(rows) == 4003
    (path / "three.json").write_text(json.dumps({"features": []}))
    with pytest.raises(ValueError):
        readers.geojson(spark, str(path), "CODE", start='{"type": "Feature",')
    (tmp_path / "o.json").write_text(json.dumps({"observations": [{"dimensions": [{"option_id": "a"}, {"option_id": "b"}], "observation": i} for i in range(50)]}))
    one, two = (sorted(readers.observations(spark, str(tmp_path / "o.json"), 2, s).collect()) for s in (None, '{"dimensions"'))
    assert one == two and len(one) == 50


def test_trim_leaves_rows_of_a_group_in_their_tasks(spark):
    """A group of most rows stays spread over the tasks that read it."""
    rows = spark.range(0, 4000, numPartitions=4).select((F.col("id") % 50 == 0).cast("int").alias("g"), F.col("id").cast("double").alias("v"))
    kept = clean.trim_within(rows, ["g"], "v", 0.01, 0.99)
    assert kept.where("g = 0").select(F.spark_partition_id()).distinct().count() == 4
    v = np.array([i for i in range(4000) if i % 50])
    assert kept.where("g = 0").count() == ((v >= np.quantile(v, 0.01)) & (v <= np.quantile(v, 0.99))).sum()
