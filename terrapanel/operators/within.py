"""Within transformations. Group means are partial aggregates joined back, never whole-group windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.joins import attach, with_scalars
from terrapanel.session import materialise


def _means(df: DataFrame, columns: list[str], by: list[str], weight: str | None) -> DataFrame:
    def mean(c: str) -> Column:
        if weight is None:
            return F.avg(c)
        w = F.col(weight).cast("double")
        return F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))
    return df.groupBy(*by).agg(*[mean(c).alias(f"__m_{c}") for c in columns])


def demean_once(df: DataFrame, columns: list[str], by: list[str], weight: str | None = None) -> DataFrame:
    out = attach(df, _means(df, columns, by, weight), by)
    return out.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(*[f"__m_{c}" for c in columns])


def demean(df: DataFrame, columns: list[str], *groupings: list[str], weight: str | None = None) -> DataFrame:
    """Subtract group means one grouping after another; exact for balanced nested layouts."""
    for by in groupings:
        df = demean_once(df, columns, by, weight)
    return df


def _level(by: list[str]) -> Column:
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"})


def absorb(df: DataFrame, columns: list[str], groupings: list[list[str]], weight: str | None = None, tol: float = 1e-13) -> list[tuple[list[str], DataFrame]]:
    """Least-squares effects of two or more groupings on every column, as (keys, table of levels with one effect a column).

    Conjugate gradients on the normal equations. The effects of the grouping with most levels are eliminated: they follow from the others by one
    group sum. A step is one pass over the distinct cells, two group sums, for all columns together; the vectors are written tables of levels, and only
    inner products reach the driver. The weight of a level preconditions. Started from the means that are left, a balanced panel is done at once; a panel with
    holes takes at most as many steps as the smaller groupings have levels. There is no limit on levels or steps.
    """
    # any order gives the same effects; the largest grouping first leaves the shortest vectors
    sizes = df.agg(*[F.approx_count_distinct(F.struct(*by)).alias(f"n{i}") for i, by in enumerate(groupings)]).first()
    order = sorted(range(len(groupings)), key=lambda i: -sizes[i])
    big, rest = groupings[order[0]], [groupings[i] for i in order[1:]]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    names = [f"__l{j}" for j in range(len(rest))]
    k = range(len(columns))
    rows = df.select(_level(big).alias("__a"), *[F.concat(F.lit(f"{j}:"), _level(by)).alias(n) for j, (by, n) in enumerate(zip(rest, names))],
                     w.alias("__w"), *[(w * F.col(c)).alias(f"__s{i}") for i, c in enumerate(columns)])
    cells = materialise(rows.groupBy("__a", *names).agg(F.sum("__w").alias("__w"), *[F.sum(f"__s{i}").alias(f"__s{i}") for i in k]))
    totals = (cells.groupBy("__a").agg(F.sum("__w").alias("__wa"), *[F.sum(f"__s{i}").alias(f"__m{i}") for i in k])
              .select("__a", "__wa", *[(F.col(f"__m{i}") / F.col("__wa")).alias(f"__m{i}") for i in k]))

    def by_level(df: DataFrame, value) -> DataFrame:
        """Sums at the levels of every other grouping."""
        long = df.select(F.explode(F.array(*names)).alias("level"), "__w", *[value(i).alias(f"v{i}") for i in k])
        return long.groupBy("level").agg(F.sum("__w").alias("w"), *[F.sum(f"v{i}").alias(f"v{i}") for i in k])

    def spread(vectors: DataFrame, of: str) -> DataFrame:
        """Cells with __t, the sum of the vectors at their levels."""
        out = cells.select("__a", *names, "__w")
        for n in names:
            at = vectors.select(F.col("level").alias(n), *[F.col(f"{of}{i}").alias(f"{n}_{i}") for i in k])
            out = out.join(at, n)
        return out.select("__a", *names, "__w", *[sum((F.col(f"{n}_{i}") for n in names[1:]), F.col(f"{names[0]}_{i}")).alias(f"__t{i}") for i in k])

    def operate(vectors: DataFrame, of: str) -> DataFrame:
        """(level, v): the normal equations, without the eliminated grouping, times the vectors."""
        t = spread(vectors, of)
        means = t.groupBy("__a").agg(F.sum("__w").alias("__wa"), *[F.sum(F.col("__w") * F.col(f"__t{i}")).alias(f"__u{i}") for i in k])
        return by_level(t.join(means, "__a"), lambda i: F.col("__w") * (F.col(f"__t{i}") - F.col(f"__u{i}") / F.col("__wa")))

    # right side: what the eliminated grouping's means leave; z, the size of what was added up, bounds its rounding
    long = cells.join(totals, "__a").select(F.explode(F.array(*names)).alias("level"), "__w", *[x for i in k for x in (
        (F.col(f"__s{i}") - F.col("__w") * F.col(f"__m{i}")).alias(f"b{i}"), (F.abs(f"__s{i}") + F.col("__w") * F.abs(f"__m{i}")).alias(f"z{i}"))])
    right = long.groupBy("level").agg(F.sum("__w").alias("w"), *[F.sum(f"{v}{i}").alias(f"{v}{i}") for v in "bz" for i in k])
    state = materialise(right.select("*", *[(F.col(f"b{i}") / F.col("w")).alias(f"x{i}") for i in k]))
    state = state.join(operate(state, "x").drop("w"), "level").withColumns({f"r{i}": F.col(f"b{i}") - F.col(f"v{i}") for i in k}).withColumns({f"d{i}": F.col(f"r{i}") / F.col("w") for i in k})
    state = materialise(state.drop(*[f"v{i}" for i in k]))

    def products(*pairs: str) -> dict[str, list[float]]:
        row = state.agg(*[F.sum(F.col(f"{a}{i}") * F.col(f"{b}{i}") / (F.lit(1.0) if a == "d" else F.col("w"))).alias(f"{a}{b}{i}") for a, b in pairs for i in k]).first()
        return {p: [row[f"{p}{i}"] or 0.0 for i in k] for p in pairs}

    start = products("bb", "zz", "rr")
    goal = [max(tol * tol * b, 1e-28 * z) for b, z in zip(start["bb"], start["zz"])]
    small, best, since = [1e-20 * b for b in start["bb"]], list(start["rr"]), 0
    state, left = state.drop(*[f"{v}{i}" for v in "bz" for i in k]), start["rr"]
    # what is small and has not halved in ten steps is rounding
    while any(x > (g if since < 10 else max(g, h)) for x, g, h in zip(left, goal, small)):
        state = materialise(state.join(operate(state, "d").select("level", *[F.col(f"v{i}").alias(f"q{i}") for i in k]), "level"))
        now = products("rr", "dq", "rq", "qq")
        left = now["rr"]
        alpha = [left[i] / now["dq"][i] if left[i] > goal[i] and now["dq"][i] > 0 else 0.0 for i in k]
        after = [max(left[i] - 2 * alpha[i] * now["rq"][i] + alpha[i] ** 2 * now["qq"][i], 0.0) if alpha[i] else 0.0 for i in k]
        beta = [after[i] / left[i] if alpha[i] else 0.0 for i in k]
        moved = {f"x{i}": F.col(f"x{i}") + F.col(f"d{i}") * alpha[i] for i in k} | {f"r{i}": F.col(f"r{i}") - F.col(f"q{i}") * alpha[i] for i in k}
        state = state.withColumns(moved).withColumns({f"d{i}": F.col(f"r{i}") / F.col("w") + F.col(f"d{i}") * beta[i] for i in k}).drop(*[f"q{i}" for i in k])
        left = after
        since = 0 if any(2 * x < y for x, y in zip(left, best)) else since + 1
        best = [min(x, y) for x, y in zip(left, best)]
    t = spread(state, "x")
    means = t.groupBy("__a").agg(*[F.sum(F.col("__w") * F.col(f"__t{i}")).alias(f"__u{i}") for i in k])
    top = totals.join(means, "__a").select("__a", *[(F.col(f"__m{i}") - F.col(f"__u{i}") / F.col("__wa")).alias(f"__e{i}") for i in k])
    return [(big, top), *[(by, state.where(F.startswith("level", F.lit(f"{j}:"))).select(F.substr("level", F.lit(len(f"{j}:") + 1)).alias("__a"), *[F.col(f"x{i}").alias(f"__e{i}") for i in k]))
                          for j, by in enumerate(rest)]]


def within_transform(df: DataFrame, columns: list[str], groupings: list[list[str]], weight: str | None = None) -> DataFrame:
    """Remove the effects of every grouping; written once.

    One grouping takes its means away. Two or more are absorbed together (:func:`absorb`), whatever their number of levels, balanced or not, weighted or not.
    """
    if len(groupings) == 1:
        return materialise(demean_once(df, columns, groupings[0], weight))
    out = df
    for n, (by, effects) in enumerate(absorb(df, columns, groupings, weight)):
        key = f"__key{n}"
        here = effects.select(F.col("__a").alias(key), *[F.col(f"__e{i}").alias(f"__e{n}_{i}") for i in range(len(columns))])
        out = out.withColumn(key, _level(by)).join(here, key).drop(key)
        out = out.withColumns({c: F.col(c) - F.col(f"__e{n}_{i}") for i, c in enumerate(columns)}).drop(*[f"__e{n}_{i}" for i in range(len(columns))])
    return materialise(out)


def connected(df: DataFrame, a: list[str], b: list[str]) -> int:
    """Components of the graph whose nodes are the levels of two groupings and whose edges are the rows."""
    pairs = materialise(df.select(_level(a).alias("a"), _level(b).alias("b")).distinct())
    labels = materialise(pairs.groupBy("b").agg(F.min("b").alias("label")))
    while True:
        around = pairs.join(labels, "b").groupBy("a").agg(F.min("label").alias("label"))
        near = pairs.join(around, "a").groupBy("b").agg(F.min("label").alias("near"))
        # the label of the label shortens chains
        further = labels.select(F.col("b").alias("near"), F.col("label").alias("further"))
        moved = materialise(labels.join(near, "b").join(further, "near").select("b", F.least("near", "further").alias("label"), F.col("label").alias("old")))
        labels = moved.select("b", "label")
        if moved.where("label <> old").isEmpty():
            return labels.select("label").distinct().count()


def share_of_variance_in_means(df: DataFrame, column: str, groupings: dict[str, list[str]]) -> DataFrame:
    """(grouping, share): sum of n*mean^2 over groups against the total sum of squares."""
    total = df.agg(F.sum(F.col(column) * F.col(column)).alias("__t"))
    out = None
    for name, by in groupings.items():
        g = df.groupBy(*by).agg(F.avg(column).alias("m"), F.count(column).alias("n"))
        part = with_scalars(g.agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s")), total).select(
            F.lit(name).alias("grouping"), (F.col("s") / F.col("__t")).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out


def within_variance_share(df: DataFrame, column: str, entity: str, group: str, period: str) -> DataFrame:
    """Share of within-entity variance explained by group-by-period means."""
    d = demean(df.where(F.col(column).isNotNull()), [column], [entity])
    rest = demean(d.withColumn("__rest", F.col(column)), ["__rest"], [group, period])
    return rest.agg((1 - F.sum(F.col("__rest") * F.col("__rest")) / F.sum(F.col(column) * F.col(column))).alias("share"))


def surviving_variance(df: DataFrame, columns: list[str], structures: dict[str, list[list[str]]]) -> DataFrame:
    """(variable, structure, share): variance left after each fixed-effect structure."""
    base = df.agg(*[F.var_samp(c).alias(c) for c in columns]).unpivot([], columns, "variable", "total_variance")
    out = None
    for name, groupings in structures.items():
        left = demean(df, columns, *groupings).agg(*[F.var_samp(c).alias(c) for c in columns]).unpivot([], columns, "variable", "left_variance")
        part = base.join(left, "variable").select("variable", F.lit(name).alias("structure"), "total_variance",
                                                  (F.col("left_variance") / F.nullif(F.col("total_variance"), F.lit(0.0))).alias("share_left"))
        out = part if out is None else out.unionByName(part)
    return out
