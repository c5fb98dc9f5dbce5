"""Panel time-series, dependence and spatial-autocorrelation tests from aggregates.

A panel of N entities by T periods is read through T-by-T moments or per-entity sums. Windows run
inside one entity (at most T rows).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from terrapanel.functions import distributions as dist
from terrapanel.functions.expressions import mixed
from terrapanel.operators import grid
from terrapanel.operators.edges import neighbour_lag
from terrapanel.operators.joins import all_of, attach, with_scalars
from terrapanel.operators.proximity import Places, Proximity, codes, in_cells, near_forms, neighbour_sums
from terrapanel.operators.proximity import links as listed_links
from terrapanel.operators.ranks import with_row_numbers
from terrapanel.operators.within import demean
from terrapanel.session import materialise


def complete_cases(df: DataFrame, entity: str, period: str, value: str, first: str = "period") -> DataFrame:
    """Rows of a balanced panel, missing values (NULL or NaN) left out.

    ``first`` = "period" keeps the periods that every entity has; "entity" keeps the entities observed in every period. The tests below
    are defined on balanced panels only.
    """
    v = F.col(value).cast("double")
    present = df.where(v.isNotNull() & ~F.isnan(v))
    by, other = (period, entity) if first == "period" else (entity, period)
    total = present.agg(F.countDistinct(other).alias("__all"))
    whole = with_scalars(present.groupBy(by).agg(F.countDistinct(other).alias("__k")), total).where("__k = __all").select(by)
    return attach(present, whole.withColumn("__whole", F.lit(1)), [by], "inner").drop("__whole")


def complete_wide(df: DataFrame, entity: str, period: str, value: str, first: str = "period") -> tuple[DataFrame, list[int]]:
    """(entity, v) with the values of the complete cases in the order of the periods, and those periods."""
    kept = complete_cases(df, entity, period, value, first)
    periods = sorted(r[0] for r in kept.select(period).distinct().collect())
    ordered = F.array_sort(F.collect_list(F.struct(F.col(period).alias("t"), F.col(value).cast("double").alias("y"))))
    return kept.groupBy(entity).agg(ordered.alias("__v")).select(entity, F.col("__v.y").alias("v")), periods


def time_gram(wide: DataFrame, t: int) -> tuple[int, np.ndarray, np.ndarray]:
    """N, period means and sum over entities of y_s * y_t: T(T+3)/2 numbers, as rows of pairs of periods."""
    one = wide.select(F.posexplode("v").alias("s", "a"), "v")
    pairs = one.select("s", "a", F.posexplode("v").alias("t", "b")).where("t >= s")
    g, mean, n = np.zeros((t, t)), np.zeros(t), 0
    for r in pairs.groupBy("s", "t").agg(F.sum(F.col("a") * F.col("b")).alias("g"), F.avg("a").alias("m"), F.count(F.lit(1)).alias("n")).collect():
        g[r["s"], r["t"]] = g[r["t"], r["s"]] = r["g"]
        mean[r["s"]], n = r["m"], r["n"]
    return n, mean, g


def within_autocorrelation(df: DataFrame, entity: str, period: str, value: str, lags: int = 5) -> DataFrame:
    d = demean(df.where(F.col(value).isNotNull()), [value], [entity])
    d = grid.add_lags(d, entity, period, [value], list(range(1, lags + 1)))
    row = d.agg(*[F.corr(value, f"{value}_lag{k}").alias(f"r{k}") for k in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"r{k}").alias("within_autocorrelation")) for k in range(1, lags + 1)])
    return row.select(F.inline(pairs))


def _centre(m: int) -> np.ndarray:
    return np.eye(m) - np.ones((m, m)) / m


def time_factors(df: DataFrame, entity: str, period: str, value: str, remove_period_means: bool, k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variance shares, time paths, entity scores) of the uncentred decomposition after removing entity means."""
    wide, periods = complete_wide(df, entity, period, value)
    n, mean, g = time_gram(wide, len(periods))
    c = _centre(len(periods))
    s = c @ g @ c
    offset = np.zeros(len(periods))
    if remove_period_means:
        offset = c @ mean
        s = s - n * np.outer(offset, offset)
    values, vectors = np.linalg.eigh(s)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    lead = vectors[np.argmax(np.abs(vectors), axis=0), range(len(periods))]
    vectors = vectors * np.where(lead < 0, -1.0, 1.0)
    spark = df.sparkSession
    shares = spark.createDataFrame([(i + 1, float(v / values.sum())) for i, v in enumerate(values)], "component long, share double")
    paths = spark.createDataFrame([(int(p), j + 1, float(vectors[i, j])) for i, p in enumerate(periods) for j in range(k)], "period long, component long, loading double")
    weights = c @ vectors
    def score(j: int) -> Column:
        weighted = F.zip_with("v", F.array(*[F.lit(float(x)) for x in weights[:, j]]), lambda y, w: y * w)
        return F.aggregate(weighted, F.lit(0.0), lambda total, x: total + x) - F.lit(float(offset @ vectors[:, j]))

    scores = wide.select(entity, *[score(j).alias(f"f{j + 1}") for j in range(k)])
    return shares, paths, scores


def factor_criteria(df: DataFrame, entity: str, period: str, value: str, kmax: int = 6) -> DataFrame:
    """Bai-Ng IC_p1..3 for 0..kmax factors after removing entity and period means."""
    wide, periods = complete_wide(df, entity, period, value)
    t = len(periods)
    n, mean, g = time_gram(wide, t)
    c = _centre(t)
    s = c @ (g - n * np.outer(mean, mean)) @ c
    values = np.sort(np.maximum(np.linalg.eigvalsh(s), 0.0))[::-1]
    low, rows = min(n, t), []
    for k in range(0, min(kmax, t - 2) + 1):
        v = float(values[k:].sum() / (n * t))
        base = (n + t) / (n * t)
        pens = [k * base * math.log(1 / base), k * base * math.log(low), k * math.log(low) / low]
        rows.append((k, v, *[math.log(v) + p for p in pens]))
    return df.sparkSession.createDataFrame(rows, "k_factors long, v double, ic_p1 double, ic_p2 double, ic_p3 double")


HT_SCHEMA = "rho double, z double, p double, n long, transitions long"
HADRI_SCHEMA = "lm double, null_mean double, z double, p double, n long, t long"


def harris_tzavalis(df: DataFrame, entity: str, period: str, value: str, trend: bool = False, remove_period_means: bool = False) -> DataFrame:
    """Fixed-T unit-root test; H0 every series has a unit root. Uses only the T-by-T moments. A panel without complete cases, or too short, has missing statistics."""
    wide, periods = complete_wide(df, entity, period, value)
    n, mean, g = time_gram(wide, len(periods))
    if remove_period_means:
        g = g - n * np.outer(mean, mean)
    t = len(periods) - 1
    if not n or t < (3 if trend else 2):
        return df.sparkSession.createDataFrame([(None, None, None, n, max(t, 0))], HT_SCHEMA)
    if trend:
        z = np.column_stack([np.ones(t), np.arange(1.0, t + 1.0)])
        p = np.eye(t) - z @ np.linalg.inv(z.T @ z) @ z.T
        centre, var = 1 - 15 / (2 * (t + 2)), 15 * (193 * t * t - 728 * t + 1147) / (112 * (t - 2) * (t + 2) ** 3)
    else:
        p = _centre(t)
        centre, var = 1 - 3 / (t + 1), 3 * (17 * t * t - 20 * t + 17) / (5 * (t - 1) * (t + 1) ** 3)
    rho = float(np.sum(p * g[1:, :-1]) / np.sum(p * g[:-1, :-1]))
    stat = math.sqrt(n) * (rho - centre) / math.sqrt(var)
    return df.sparkSession.createDataFrame([(rho, stat, dist.normal_cdf(stat), n, t)], HT_SCHEMA)


def hadri_moments(t: int) -> tuple[float, float]:
    """Exact mean and variance of the unit statistic for iid normal deviations and finite T."""
    m, low = _centre(t), np.tril(np.ones((t, t)))
    a = m @ low.T @ low @ m
    mean = float(np.trace(a)) / (t * (t - 1))
    second = float(np.trace(a) ** 2 + 2 * np.trace(a @ a)) / (t * t * (t - 1) * (t + 1))
    return mean, second - mean * mean


def hadri(df: DataFrame, entity: str, period: str, value: str, remove_period_means: bool = False) -> DataFrame:
    """LM stationarity test; H0 every series is stationary around its mean. Constant series are left out; without any other the statistics are missing."""
    d = demean(complete_cases(df, entity, period, value).select(entity, period, F.col(value).cast("double").alias("__e")), ["__e"], *([[period]] if remove_period_means else []), [entity])
    d = grid.add_running_sum(d, "__e", "__s", entity, period)
    unit = d.groupBy(entity).agg(F.count(F.lit(1)).alias("__t"), F.sum(F.col("__s") ** 2).alias("__ss"), F.sum(F.col("__e") ** 2).alias("__ee"))
    t = unit.agg(F.max("__t")).first()[0] or 0
    unit = unit.where((F.col("__t") == t) & (F.col("__ee") > 1e-20)).withColumn("__lm", F.col("__ss") / (F.col("__t") * F.col("__ee")))
    row = unit.agg(F.avg("__lm").alias("lm"), F.count(F.lit(1)).alias("n")).first()
    if t < 2 or not row["n"]:
        return df.sparkSession.createDataFrame([(None, None, None, None, row["n"], t)], HADRI_SCHEMA)
    mean, var = hadri_moments(t)
    z = math.sqrt(row["n"]) * (row["lm"] - mean) / math.sqrt(var)
    return df.sparkSession.createDataFrame([(row["lm"], mean, z, 1.0 - dist.normal_cdf(z), row["n"], t)], HADRI_SCHEMA)


# MacKinnon (1994) response surface for the constant-only Dickey-Fuller t-statistic.
DF_TAU_MIN, DF_TAU_STAR, DF_TAU_MAX = -18.83, -1.61, 2.74
DF_SMALL_P = [2.1659, 1.4412, 0.038269]
DF_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]


def _poly(x: Column, coefs: list[float]) -> Column:
    return sum((F.lit(c) * F.pow(x, F.lit(float(i))) for i, c in enumerate(coefs[1:], 1)), F.lit(coefs[0]))


def unit_adf(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Per entity: Dickey-Fuller t (constant, no lags) and the normal score of its p-value."""
    w = grid.along(entity, period)
    d = df.where(F.col(value).isNotNull()).withColumn("__l", F.lag(value).over(w)).withColumn("__dy", F.col(value) - F.col("__l")).where(F.col("__l").isNotNull())
    unit = d.groupBy(entity).agg(F.regr_count("__dy", "__l").alias("n"), F.regr_sxx("__dy", "__l").alias("sxx"), F.regr_sxy("__dy", "__l").alias("sxy"), F.regr_syy("__dy", "__l").alias("syy"))
    b = F.col("sxy") / F.col("sxx")
    s2 = (F.col("syy") - F.col("sxy") * b) / (F.col("n") - 2)
    unit = unit.where("sxx > 1e-20 AND n > 2").withColumn("t", b / F.sqrt(s2 / F.col("sxx")))
    score = (F.when(F.col("t") > DF_TAU_MAX, F.lit(float("inf"))).when(F.col("t") < DF_TAU_MIN, F.lit(float("-inf")))
             .when(F.col("t") <= DF_TAU_STAR, _poly(F.col("t"), DF_SMALL_P)).otherwise(_poly(F.col("t"), DF_LARGE_P)))
    bound = 6.361340902404056   # normal quantile of 1 - 1e-10
    return unit.select(entity, "n", "t", F.greatest(F.lit(-bound), F.least(F.lit(bound), score)).alias("normal_score"))


def combined_adf(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Inverse-normal combination over entities with every period; constant series are excluded and counted."""
    df = complete_cases(df, entity, period, value, "entity")
    u = unit_adf(df, entity, period, value)
    row = u.agg(F.count(F.lit(1)).alias("n"), F.sum("normal_score").alias("s"), F.avg((F.col("normal_score") < -1.6448536269514722).cast("double")).alias("share")).first()
    n_all = df.where(F.col(value).isNotNull()).agg(F.countDistinct(entity)).first()[0]
    z = row["s"] / math.sqrt(row["n"]) if row["n"] else None
    return df.sparkSession.createDataFrame([(row["n"], n_all - row["n"], row["share"], z, None if z is None else dist.normal_cdf(z))], "n long, n_excluded long, share_reject double, z double, p double")


def standardised(df: DataFrame, entity: str, period: str, value: str, out: str = "s") -> DataFrame:
    """Complete cases centred per entity and scaled to unit sum of squares; entities without variation are dropped."""
    d = demean(complete_cases(df, entity, period, value).withColumn(out, F.col(value).cast("double")), [out], [entity])
    ss = d.groupBy(entity).agg(F.sum(F.col(out) ** 2).alias("__ss"))
    return attach(d, ss, [entity], "inner").where("__ss > 1e-20").withColumn(out, F.col(out) / F.sqrt("__ss")).drop("__ss")


def pesaran_cd(df: DataFrame, entity: str, period: str, value: str, names: str | None = None) -> DataFrame:
    """CD and mean pairwise correlation. The pair sum is (sum_t (sum_i s_it)^2 - N) / 2: one pass, no pairs."""
    s = standardised(df, entity, period, value)
    by_t = s.groupBy(period).agg(F.sum("s").alias("p"), F.count(F.lit(1)).alias("k"))
    row = by_t.agg(F.sum(F.col("p") ** 2).alias("q"), F.count(F.lit(1)).alias("t"), F.max("k").alias("n")).first()
    n, t = row["n"] or 0, row["t"]
    if n < 2:
        return df.sparkSession.createDataFrame([(names or value, None, None, None, n, t)], "label string, cd double, p double, mean_corr double, n long, t long")
    total = (row["q"] - n) / 2.0
    cd = math.sqrt(2.0 * t / (n * (n - 1.0))) * total
    return df.sparkSession.createDataFrame([(names or value, cd, dist.normal_two_sided(cd), total / (n * (n - 1) / 2.0), n, t)],
                                           "label string, cd double, p double, mean_corr double, n long, t long")


def remove_effects(df: DataFrame, entity: str, period: str, value: str, group: str | None = None, min_entities: int = 0) -> DataFrame:
    """Entity means, then period or group-by-period means; groups below ``min_entities`` are set to zero."""
    d = demean(complete_cases(df, entity, period, value), [value], [entity])
    d = demean(d, [value], [group, period] if group else [period])
    if group and min_entities:
        size = d.groupBy(group).agg(F.countDistinct(entity).alias("__k"))
        d = attach(d, size, [group]).withColumn(value, F.when(F.col("__k") >= min_entities, F.col(value)).otherwise(0.0)).drop("__k")
    return d


def neighbour_correlation(df: DataFrame, edges: DataFrame | Proximity, entity: str, period: str, value: str) -> DataFrame:
    """Mean over unordered neighbour pairs of the correlation of their series."""
    s = standardised(df, entity, period, value).select(entity, period, "s")
    if isinstance(edges, Proximity):
        s = materialise(s)
        lag = neighbour_sums(edges, s, entity, [period], {"a": F.col("s")}, {})
        total = s.join(lag, [entity, period]).agg((F.sum(F.col("s") * F.col("a")) / 2).alias("r"))
        # pairs count once if they have a period in common: neighbours are counted by the periods that they have
        seen = materialise(s.where(F.col(period).isNotNull()).groupBy(entity).agg(F.concat_ws(",", F.array_sort(F.collect_set(F.col(period).cast("string")))).alias("__has")))
        met = neighbour_sums(edges.distinct(), seen.withColumnRenamed("__has", "__with"), entity, ["__with"], {}, {}).join(seen, entity)
        common = met.where(F.arrays_overlap(F.split("__has", ","), F.split("__with", ",")))
        pairs = common.agg(F.coalesce(F.sum("__links") / 2, F.lit(0)).cast("long").alias("n_pairs"))
        return with_scalars(pairs, total).select("n_pairs", (F.col("r") / F.nullif(F.col("n_pairs").cast("double"), F.lit(0.0))).alias("mean_corr"))
    e = edges.where("src < dst").select("src", "dst")
    a = e.join(s.select(F.col(entity).alias("src"), period, F.col("s").alias("a")), "src")
    j = a.join(s.select(F.col(entity).alias("dst"), period, F.col("s").alias("b")), ["dst", period])
    return j.groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("r")).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("r").alias("mean_corr"))


def _deviations(values: DataFrame, entity: str, value: str, by: list[str]) -> DataFrame:
    v = values.where(F.col(value).isNotNull()).select(entity, *by, F.col(value).cast("double").alias("z"))
    return demean(v, ["z"], by)


def _lagged(values: DataFrame, edges: DataFrame | Proximity, entity: str, value: str, by: list[str]) -> DataFrame:
    """(entity, by, z, wz, degree): deviations, the mean of the neighbours' and their number, NULL without neighbours."""
    z = _deviations(values, entity, value, by)
    return attach(z, neighbour_lag(edges, z, entity, by, "z", "wz"), [entity, *by])


def _global_i(lagged: DataFrame, by: list[str]) -> DataFrame:
    return lagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count("z") / F.count("wz") * F.sum(F.col("z") * F.col("wz")) / F.sum(F.col("z") ** 2)).alias("morans_i"))


def morans_i(values: DataFrame, edges: DataFrame | Proximity, entity: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Row-standardised Moran's I per group: z'Wz / z'z scaled by n over the number of linked entities."""
    by = by or []
    return _global_i(_lagged(values, edges, entity, value, by), by)


def _order(n: int, rep: int, seed: int) -> np.ndarray:
    """Numbers 0 .. n-1 of a group's entities in the replication's order; ties by number."""
    number = np.arange(n, dtype=np.int64)
    # keys are under 2^31, so key and number sort as one
    return np.sort(mixed(number + 1, rep, seed) << 32 | number) & (1 << 32) - 1


def _first(n: int, rep: int, seed: int, k: int) -> np.ndarray:
    """The first ``k`` of ``_order``, without sorting the others."""
    keys = mixed(np.arange(1, n + 1, dtype=np.int64), rep, seed)
    among = np.flatnonzero(keys <= np.partition(keys, k - 1)[k - 1]) if k < n else np.arange(n)
    return among[np.argsort(keys[among], kind="stable")][:k]


def _folded_p(larger: Column, reps: Column) -> Column:
    return (F.least(larger, reps - larger) + 1) / (reps + 1.0)


#: Replications of a task, and entities whose links one task takes; of links that are not written, and reassigned values held at once.
BLOCK, LINKS, PART, HELD = 100, 1 << 16, 1 << 18, 1 << 26


def _blocks(reps: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // BLOCK)))


def _spread(df: DataFrame, keys: list[str]) -> GroupedData:
    """``df`` by ``keys`` in a fixed number of partitions: few bytes make much work here, so blocks are not to be put together by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def _kinds(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in columns)


def _keyed(key: tuple, by: list[str], n: int, schema: pa.Schema) -> dict:
    return {c: pa.array([k.as_py()] * n, schema.field(c).type) for c, k in zip(by, key)}


def _permuted_sums(by: list[str], reps: int, seed: int):
    """Sum of z times its lag, over the entities of a part, in every replication of a block."""
    def run(key: tuple, values: pa.Table, links: pa.Table) -> pa.Table:
        block = key[len(by)].as_py()
        number, z = values["__i"].to_numpy() - 1, values["__z"].to_numpy()
        z = z[np.argsort(number)]
        src, dst = links["__src"].to_numpy() - 1, links["__dst"].to_numpy() - 1
        own, place, degree = np.unique(src, return_inverse=True, return_counts=True)
        numbers = np.arange(block * BLOCK + 1, min((block + 1) * BLOCK, reps) + 1)
        out = np.zeros(len(numbers))
        for k, rep in enumerate(numbers if len(z) else []):
            moved = z[_order(len(z), int(rep), seed)]
            out[k] = moved[own] @ (np.bincount(place, moved[dst], len(own)) / degree)
        return pa.table({**_keyed(key, by, len(numbers), values.schema), "rep": pa.array(numbers, pa.int32()), "s": pa.array(out, pa.float64())})
    return run


def _permuted_near(by: list[str], reps: int, seed: int, radius: float):
    """As ``_permuted_sums``, with the links between places within ``radius`` of entities with links; a part takes some of the links."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block, part = key[len(by)].as_py(), key[len(by) + 1].as_py()
        z = np.zeros(rows["__i"].to_numpy().max())
        z[rows["__i"].to_numpy() - 1] = rows["__z"].to_numpy()
        placed = rows.filter(pc.and_(rows["__x"].is_valid(), pc.greater(pc.fill_null(rows["__degree"], 0), 0)))
        points = Places(placed["__x"].to_numpy(), placed["__y"].to_numpy(), codes([placed["__e"]], len(placed))[1], np.zeros(len(placed), np.int64))
        order = in_cells(points, radius)[1]
        points, number, shares = points.take(order), placed["__i"].to_numpy()[order] - 1, 1.0 / placed["__degree"].to_numpy()[order]
        numbers = np.arange(block * BLOCK + 1, min((block + 1) * BLOCK, reps) + 1)
        out = []
        for some in np.array_split(numbers, -(-len(numbers) * len(number) // HELD) or 1):
            moved = np.empty((len(number), len(some)))
            for k, rep in enumerate(some):
                moved[:, k] = z[_order(len(z), int(rep), seed)][number]
            out.append(near_forms(points, shares, moved, radius, part, (len(z) - 1) // PART + 1))
        return pa.table({**_keyed(key, by, len(numbers), rows.schema), "rep": pa.array(numbers, pa.int32()), "s": pa.array(np.concatenate(out), pa.float64())})
    return run


def _numbered_links(z: DataFrame, edges: DataFrame, entity: str, by: list[str]) -> DataFrame:
    """(by, __src, __dst) of the links between entities that have a value in the group, by their numbers."""
    ends = z.select(*by, F.col(entity).alias("__e"), F.col("__i"))
    left = edges.select(F.col("src").alias("__e"), F.col("dst").alias("__to")).join(ends, "__e").select(*by, F.col("__i").alias("__src"), F.col("__to").alias("__e"))
    return left.join(ends.withColumnRenamed("__i", "__dst"), [*by, "__e"]).select(*by, "__src", "__dst")


def moran_permutation(values: DataFrame, edges: DataFrame | Proximity, entity: str, value: str, by: list[str] | None = None, reps: int = 999, seed: int = 7) -> DataFrame:
    """Moran's I of every group with permutation p-value and z-score (the group's values reassigned to its entities at random).

    A task takes a block of replications of one group and the links of a part of its entities; it holds the group's values, 8 bytes an entity,
    and adds one number a replication. The links of a ``Proximity`` are not written: the task holds the places and a block of reassigned values, and a link counts
    with the shares (one over the number of links) of both its entities. Entities without links keep their value and take part in the reassignment. A replication
    counts as larger if its I reaches the actual one up to rounding.
    """
    by = by or []
    if isinstance(edges, Proximity) and edges.across:
        edges = listed_links(edges)
    numbered = with_row_numbers(_lagged(values, edges, entity, value, by), by, [F.col(entity).asc()], "__i", "__n")
    lagged = materialise(numbered.select(*by, entity, "__i", "__n", "z", "wz", F.col("degree").cast("long").alias("__degree")))
    actual, z = _global_i(lagged, by), lagged.withColumn("__z", F.col("z"))
    stats = z.groupBy(*by).agg(F.sum(F.col("__z") ** 2).alias("__zz"), F.max("__n").alias("__n"), F.count_if(F.col("__degree") > 0).alias("__linked"))
    if isinstance(edges, Proximity):
        # a group without a name has no links, as in a table of pairs
        stats = stats.withColumn("__linked", F.when(all_of([F.col(c).isNotNull() for c in by]), F.nullif("__linked", F.lit(0))))
        places = edges.nodes.select(F.col("id").alias(entity), F.col("x").alias("__x"), F.col("y").alias("__y"))
        rows = materialise(z.join(places, entity, "left").select(*by, F.col(entity).alias("__e"), "__i", "__n", "__z", "__degree", "__x", "__y"))
        rows = rows.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / PART)))).drop("__n").withColumn("__block", _blocks(reps))
        sums = _spread(rows, [*by, "__block", "__part"]).applyInArrow(_permuted_near(by, reps, seed, edges.radius), _kinds(rows, by) + "rep int, s double")
    else:
        links = materialise(_numbered_links(z, edges, entity, by).withColumn("__part", F.floor(F.col("__src") / LINKS)))
        stats = attach(stats.drop("__linked"), links.groupBy(*by).agg(F.count_distinct("__src").alias("__linked")), by)
        parts = z.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / LINKS))))
        keys = [*by, "__block", "__part"]
        left = parts.withColumn("__block", _blocks(reps)).select(*keys, "__i", "__z")
        right = links.withColumn("__block", _blocks(reps)).select(*[F.col(c).alias(c) for c in by], F.col("__block").alias("__block"), F.col("__part").alias("__part"), F.col("__src").alias("__src"), F.col("__dst").alias("__dst"))
        sums = _spread(left, keys).cogroup(_spread(right, keys)).applyInArrow(_permuted_sums(by, reps, seed), _kinds(left, by) + "rep int, s double")
    sims = attach(sums.groupBy(*by, "rep").agg(F.sum("s").alias("s")), stats, by)
    sims = sims.withColumn("i", F.col("__n") / F.col("__linked") * F.col("s") / F.col("__zz"))
    both = attach(sims, actual, by)
    near = F.col("i") >= F.col("morans_i") - 1e-9 * F.abs("morans_i")
    s = both.groupBy(*by).agg(F.max("n").alias("n"), F.max("morans_i").alias("morans_i"), F.count(F.lit(1)).alias("reps"), F.count_if(near).alias("larger"), F.avg("i").alias("m"), F.stddev_pop("i").alias("sd"))
    return s.select(*by, "n", "morans_i", ((F.col("morans_i") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("z_sim"),
                    F.when(F.col("morans_i").isNotNull(), _folded_p(F.col("larger"), F.col("reps"))).alias("p_sim"))


def local_moran(values: DataFrame, edges: DataFrame | Proximity, entity: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(entity, by, z, wz, degree, local_i, quadrant) with quadrant 1 HH, 2 LH, 3 LL, 4 HL; without neighbours the degree is 0, the rest NULL."""
    by = by or []
    z = _deviations(values, entity, value, by)
    lag = neighbour_lag(edges, z, entity, by, "z", "wz")
    total = z.groupBy(*by).agg(F.sum(F.col("z") ** 2).alias("__ss"), F.count(F.lit(1)).alias("__n"))
    j = attach(z.join(lag, [entity, *by], "left").withColumn("degree", F.coalesce("degree", F.lit(0))), total, by)
    up, around = F.col("z") > 0, F.col("wz") > 0
    quadrant = F.when(F.col("wz").isNull(), None).when(up & around, 1).when(~up & around, 2).when(~up & ~around, 3).otherwise(4)
    return j.select(entity, *by, "z", "wz", "degree", ((F.col("__n") - 1) * F.col("z") * F.col("wz") / F.nullif(F.col("__ss"), F.lit(0.0))).alias("local_i"), quadrant.alias("quadrant"))


def _conditional_counts(by: list[str], reps: int, seed: int):
    """Per entity, the replications of a block whose draw of neighbours gives as large a local statistic."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[len(by)].as_py()
        at = np.argsort(rows["__i"].to_numpy())
        number, z, degree = (rows[c].to_numpy()[at] for c in ("__i", "z", "degree"))
        actual = z * np.nan_to_num(rows["wz"].to_numpy(zero_copy_only=False)[at].astype(float))
        n, top, linked, larger = len(z), int(degree.max()), degree > 0, np.zeros(len(z), np.int64)
        least, divisor = actual - 1e-9 * np.abs(actual), np.maximum(degree, 1)
        for rep in range(block * BLOCK + 1, min((block + 1) * BLOCK, reps) + 1):
            first = _first(n, rep, seed, top + 1)
            sums = np.concatenate([[0.0], np.cumsum(z[first])])
            drawn = sums[degree]
            # an entity inside its own draw is replaced by the next one
            inside = first[np.arange(len(first)) < degree[first]]
            drawn[inside] = sums[np.minimum(degree[inside] + 1, len(sums) - 1)] - z[inside]
            larger += linked & (z * drawn / divisor >= least)
        return pa.table({**_keyed(key, by, n, rows.schema), "__i": pa.array(number, pa.int64()), "larger": pa.array(larger, pa.int64())})
    return run


def local_moran_permutation(values: DataFrame, edges: DataFrame | Proximity, entity: str, value: str, by: list[str] | None = None, reps: int = 999, seed: int = 7) -> DataFrame:
    """Local Moran with a conditional permutation p per entity and group; entities without neighbours have none.

    Each replication orders a group's values at random; an entity's draw is the first ``degree`` of them other than itself, so running sums
    answer every entity and no sample is built for each; only the first values that some draw reaches are put in order. A task takes a block of
    replications of one group and holds four numbers an entity.
    """
    by = by or []
    local = materialise(with_row_numbers(local_moran(values, edges, entity, value, by), by, [F.col(entity).asc()], "__i", "__n"))
    rows = local.withColumn("__block", _blocks(reps)).select(*by, "__block", "__i", "z", "wz", F.col("degree").cast("long").alias("degree"))
    counts = _spread(rows, [*by, "__block"]).applyInArrow(_conditional_counts(by, reps, seed), _kinds(local, by) + "`__i` bigint, larger bigint")
    counts = counts.groupBy(*by, "__i").agg(F.sum("larger").alias("larger"))
    p = F.when(F.col("degree") > 0, _folded_p(F.col("larger"), F.lit(reps)))
    return attach(local, counts, [*by, "__i"]).withColumn("p_sim", p).drop("__i", "__n", "larger")


def cluster_types(lisa: DataFrame, level: float = 0.05, by: list[str] | None = None) -> DataFrame:
    kind = F.when(F.col("p_sim").isNull() | (F.col("p_sim") >= level), "not significant").otherwise(
        F.element_at(F.array(*[F.lit(x) for x in ("High-High", "Low-High", "Low-Low", "High-Low")]), F.col("quadrant").cast("int")))
    return lisa.groupBy(*(by or []), kind.alias("cluster_type")).agg(F.count(F.lit(1)).alias("n"))
