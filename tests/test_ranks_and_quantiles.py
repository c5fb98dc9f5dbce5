"""Exact quantiles and ranks against numpy and pandas, with one dominant group, heavy ties and values far from zero."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import quantiles as q
from terrapanel.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    v = np.where(rng.random(n) < 0.33, 0.0, np.round(rng.normal(0, 1000, n), 2))
    v[:5] = [1e-300, -1e-300, 1e300, -1e300, 0.0]
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 20, n).astype(str)), "k": np.arange(n), "v": v})
    pdf.loc[10:20, "v"] = None
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7).cache(), pdf


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_match_numpy(skewed, by):
    df, pdf = skewed
    probs = {"lo": 0.005, "p25": 0.25, "mid": 0.5, "hi": 0.995, "top": 1.0, "low": 0.0}
    got = {tuple(r[c] for c in by): r for r in q.exact_quantiles(df, by, "v", probs).collect()}
    groups = list(pdf.dropna().groupby(by[0]) if by else [((), pdf.dropna())])
    assert len(got) == len(groups)
    for key, part in groups:
        for name, p in probs.items():
            assert got[(key,) if by else ()][name] == pytest.approx(np.quantile(part["v"], p), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("desc", [False, True])
def test_value_ranks_match_pandas(skewed, desc):
    df, pdf = skewed
    got = {(r.g, r.v): r for r in q.value_ranks(df, ["g"], "v", desc).collect()}
    clean = pdf.dropna()
    for method, column in (("min", "rank_min"), ("average", "rank_avg")):
        want = clean.groupby("g")["v"].rank(method=method, ascending=not desc)
        assert all(got[(g, v)][column] == w for g, v, w in zip(clean["g"], clean["v"], want))
    sizes = clean.groupby("g").size()
    assert all(r.group_n == sizes[r.g] for r in got.values())


@pytest.mark.parametrize("name", ["epoch", "near_100", "outlier", "integers", "tied"])
def test_partitions_follow_the_data(spark, name):
    """No task of the sort holds more than a small part of the distinct values, wherever they lie and however often they occur."""
    n = 200_000
    rng = np.random.default_rng(11)
    v = {"epoch": 1.7e9 + rng.random(n) * 86_400, "near_100": rng.normal(100, 0.01, n), "integers": rng.permutation(n).astype(float) + 2.0 ** 40,
         "outlier": np.append(rng.normal(1e9, 1, n - 2), [1.004e9, 1.0e9 - 4e5]), "tied": np.where(rng.random(n) < 0.5, 7.0, rng.normal(7, 1, n))}[name]
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(8)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed, total = q.in_order(q.value_counts(df, [], "v"), [F.col("__v").asc()])
        sizes = [r["count"] for r in placed.groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert total == n and len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16
    got = q.exact_quantiles(df, [], "v", {"a": 0.005, "b": 0.5, "c": 0.995}).first()
    assert [got.a, got.b, got.c] == pytest.approx(np.quantile(v, [0.005, 0.5, 0.995]), rel=1e-14)


def test_average_ranks_of_many_columns(skewed):
    df, pdf = skewed
    both = df.withColumns({"w": F.col("k") % 50, "__part": F.lit(1), "group_n": F.lit("x")})
    got = {r.k: (r.rank_v, r.rank_w) for r in q.with_average_ranks(both, ["g"], ["v", "w"], "rank_").collect()}
    want = pdf.assign(w=pdf["k"] % 50).groupby("g")[["v", "w"]].rank(method="average")
    assert len(got) == len(pdf)
    for k, v, w in zip(pdf["k"], want["v"], want["w"]):
        assert got[k] == ((None if np.isnan(v) else v), w)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, v double, k long")
    assert q.exact_quantiles(empty, [], "v", {"m": 0.5}).collect() == [] or q.exact_quantiles(empty, [], "v", {"m": 0.5}).first().m is None
    assert q.exact_quantiles(empty, ["g"], "v", {"m": 0.5}).collect() == []
    assert q.with_average_ranks(empty, ["g"], ["v"], "r_").collect() == [] and ranks.with_tile(empty, "v", "k", 4, "q").collect() == []


def test_clashing_names(spark):
    df = spark.createDataFrame([(float(i % 5), i, 2, 3, 4) for i in range(20)], "v double, k long, __part int, row_num int, group_n int")
    assert ranks.with_tile(df, "v", "k", 4, "q").groupBy("q").count().count() == 4


def test_row_numbers_match_pandas(skewed):
    df, pdf = skewed
    got = {r.k: (r.row_num, r.group_n) for r in ranks.with_row_numbers(df, ["g"], [F.col("v").asc_nulls_last(), F.col("k").asc()]).collect()}
    ordered = pdf.sort_values(["v", "k"], na_position="last")
    numbers, sizes = ordered.groupby("g").cumcount() + 1, pdf.groupby("g").size()
    assert got == {k: (i, sizes[g]) for k, i, g in zip(ordered["k"], numbers, ordered["g"])}


def test_top_share_matches_pandas(skewed):
    df, pdf = skewed
    pos = df.withColumn("w", F.abs("v")).where("w < 1e200")
    got = {r.g: r.s for r in q.top_share(pos, ["g"], "w", 0.1, "s").collect()}
    clean = pdf.assign(w=pdf["v"].abs()).dropna().query("w < 1e200")
    for g, part in clean.groupby("g"):
        top = part["w"].nlargest(int(np.floor(len(part) * 0.1))).sum()
        assert got[g] == pytest.approx(top / part["w"].sum(), rel=1e-12)


def test_tile_rules_differ_in_where_the_remainder_goes(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 1.0)
    sizes = {}
    for rule in ("ntile", "spread"):
        t = ranks.with_tile(df, "v", "id", 4, "q", rule)
        sizes[rule] = [r["count"] for r in t.groupBy("q").count().orderBy("q").collect()]
    assert sizes == {"ntile": [3, 3, 2, 2], "spread": [2, 3, 2, 3]}


def test_quartile_sizes_at_published_n(spark):
    n = 6791
    df = spark.range(n).withColumn("v", F.col("id") % 97)
    ntile = [r["count"] for r in ranks.with_tile(df, "v", "id", 4, "q").groupBy("q").count().orderBy("q").collect()]
    spread = [r["count"] for r in ranks.with_tile(df, "v", "id", 4, "q", "spread").groupBy("q").count().orderBy("q").collect()]
    assert ntile == [1698, 1698, 1698, 1697] and spread == [1697, 1698, 1698, 1698]


def test_bins_drop_repeated_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 7 + [1, 2, 3]], "v double")
    got = sorted(r.b for r in q.quantile_bins(df, [], "v", 4, "b").collect())
    want = pd.qcut([0.0] * 7 + [1, 2, 3], 4, labels=False, duplicates="drop") + 1
    assert got == sorted(want)


def test_nan_is_no_valid_measure(spark):
    from terrapanel.plans import price_panel as pp
    rows = [(1, 2000, float(p), 1.0, "A", "F") for p in (1, 2, 3, 4)] + [(1, 2000, float("nan"), 1.0, "A", "F")]
    from terrapanel.operators import clean
    sales = clean.valid_measures(spark.createDataFrame(rows, "area_id long, year int, price double, size double, kind string, status string"), {"price": 0.0, "size": 0.0})
    got = pp.aggregate_panel(sales.withColumn("unit", F.col("price") / F.col("size")), [2]).first()
    assert (got.sale_count, got.median_price, got.p25_unit, got.p75_unit) == (4, 2.5, 1.75, 3.25)
