"""Exact quantiles, ranks and bins from one distributed sort.

Rows collapse to distinct values with counts (map-side first, so heavy ties cost one row a task). Those are range partitioned on (group, value),
sorted, and their counts added up inside each partition; the partitions' totals, one number each, place every value in the whole order. A
group's values stand together there, so its first place and its size turn places into ranks. No group meets in one task,
whatever its size, the scale of its values or its ties; there is one plan for all sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from terrapanel.operators.joins import any_of, attach, with_scalars
from terrapanel.session import materialise


def _present(df: DataFrame, value: str) -> DataFrame:
    kept = df.where(F.col(value).isNotNull())
    return kept.where(~F.isnan(value)) if dict(df.dtypes)[value] in ("double", "float") else kept


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, __v, __c): distinct non-missing values with multiplicity."""
    src = _present(df.select(*by, F.col(value).alias("__v")), "__v")
    return src.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds __upto, the sum of __c from the start of the partition."""
    total = 0
    for batch in batches:
        upto = total + np.cumsum(batch.column("__c").to_numpy(zero_copy_only=False), dtype=np.int64)
        total = int(upto[-1]) if len(upto) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, pa.int64())], [*batch.schema.names, "__upto"])


def in_order(counts: DataFrame, keys: list[Column]) -> tuple[DataFrame, int]:
    """``counts`` sorted by ``keys`` over all partitions, with __to (the sum of __c through the row), and the sum of all; written once."""
    ordered = counts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
    stored = materialise(ordered.mapInArrow(_added_up, StructType([*ordered.schema.fields]).add("__upto", LongType())))
    # one number a partition
    ends = {r[0]: r[1] for r in stored.groupBy("__part").agg(F.max("__upto")).collect()}
    last = max(ends, default=0)
    sums = np.cumsum([0] + [ends.get(i, 0) for i in range(last + 1)])
    before = F.lit([int(x) for x in sums[:-1]]).cast("array<bigint>")
    return stored.withColumn("__to", F.col("__upto") + F.get(before, F.col("__part"))).drop("__part", "__upto"), int(sums[-1])


def _cumulative(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, __v, __c, __from, __to, __n): each distinct value of each group with the rows before it and through it."""
    placed, n = in_order(value_counts(df, by, value), [*[F.col(c).asc_nulls_first() for c in by], F.col("__v").asc()])
    if not by:
        return placed.withColumns({"__from": F.col("__to") - F.col("__c"), "__n": F.lit(n).cast("long")})
    groups = placed.groupBy(*by).agg(F.min(F.col("__to") - F.col("__c")).alias("__start"), F.sum("__c").alias("__n"))
    out = attach(placed, groups, by, "inner").withColumn("__to", F.col("__to") - F.col("__start")).drop("__start")
    return out.withColumn("__from", F.col("__to") - F.col("__c"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group: one row per group, one column per name.

    ``probs`` maps output column names to probabilities. Missing values (NULL or NaN) are ignored.
    """
    n = F.col("__n")
    pos = {name: F.lit(float(p)) * (n - 1).cast("double") for name, p in probs.items()}
    lo = {name: F.floor(r) for name, r in pos.items()}
    hi = {name: F.ceil(r) for name, r in pos.items()}

    def holds(rank: Column) -> Column:
        return (F.col("__from") <= rank) & (rank < F.col("__to"))

    placed = _cumulative(df.select(*by, F.col(value).cast("double").alias("__x")), by, "__x")
    picks = []
    for name in probs:
        picks += [F.max(F.when(holds(lo[name]), F.col("__v"))).alias(f"__lo_{name}"), F.max(F.when(holds(hi[name]), F.col("__v"))).alias(f"__hi_{name}")]
    agg = placed.where(any_of([holds(r) for d in (lo, hi) for r in d.values()])).groupBy(*by).agg(F.max("__n").alias("__n"), *picks)
    out = []
    for name in probs:
        a, b = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        d = pos[name] - lo[name]
        out.append((a + (b - a) * d).alias(name))
    return agg.select(*by, *out)


def long_values(df: DataFrame, by: list[str], columns: list[str], name: str = "variable",
                value: str = "value") -> DataFrame:
    """Measures as (by, variable, value) rows, so one plan serves every column."""
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        by, columns, name, value)


def value_ranks(df: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """Per distinct value: best rank, average rank, ties and group size."""
    placed = _cumulative(df, by, value)
    before = (F.col("__n") - F.col("__to")) if descending else F.col("__from")
    return placed.select(
        *by, F.col("__v").alias(value), F.col("__c").alias("ties"), F.col("__n").alias("group_n"),
        (before + 1).alias("rank_min"), (before + (F.col("__c") + 1) / 2.0).alias("rank_avg"))


def with_value_ranks(df: DataFrame, by: list[str], value: str, descending: bool = False,
                     prefix: str = "") -> DataFrame:
    ranks = value_ranks(df, by, value, descending)
    keep = {c: f"{prefix}{c}" for c in ("ties", "group_n", "rank_min", "rank_avg")}
    return attach(df, ranks.select(*by, value, *[F.col(c).alias(a) for c, a in keep.items()]),
                  [*by, value])


def with_average_ranks(df: DataFrame, by: list[str], columns: list[str], prefix: str = "") -> DataFrame:
    """Every row of ``df`` with the average rank of each column in its group, as prefix + column; missing values have none.

    All columns are ranked by one sort and come back by one join, whatever their number.
    """
    name, value, row = "__variable", "__value", "__row"
    stored = materialise(df.withColumn(row, F.monotonically_increasing_id()))
    long = stored.select(row, *by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([row, *by], columns, name, value)
    keys = [*by, name]
    ranks = value_ranks(long, keys, value).select(*keys, value, "rank_avg")
    ranked = attach(_present(long, value), ranks, [*keys, value], "inner")
    wide = ranked.groupBy(row).agg(*[F.max(F.when(F.col(name) == c, F.col("rank_avg"))).alias(f"{prefix}{c}") for c in columns])
    return stored.join(wide, row, "left").drop(row)


def quantile_bins(df: DataFrame, by: list[str], value: str, k: int, out: str) -> DataFrame:
    """Quantile-edge bins 1..k, right-closed with the lowest value included.

    Equal edges collapse into one, so tied data yields fewer bins, numbered without gaps.
    """
    probs = {f"__e{i}": i / k for i in range(k + 1)}
    edges = exact_quantiles(df, by, value, probs)
    edges = edges.select(*by, F.array_distinct(F.array(*probs)).alias("__edges"))
    v = F.col(value).cast("double")
    inner = F.slice("__edges", 2, F.greatest(F.size("__edges") - 2, F.lit(0)))
    number = F.size(F.filter(inner, lambda e: e < v)) + 1
    return (attach(df, edges, by)
            .withColumn(out, F.when(v.isNotNull(), number)).drop("__edges"))


def top_share(df: DataFrame, by: list[str], value: str, fraction: float, out: str) -> DataFrame:
    """Share of a group's total held by its floor(fraction*n) largest units."""
    placed = _cumulative(df, by, value)
    k = F.floor(F.col("__n") * F.lit(fraction))
    above = F.col("__n") - F.col("__to")
    taken = F.greatest(F.lit(0), F.least(F.col("__c"), k - above))
    return placed.groupBy(*by).agg(
        (F.sum(F.col("__v") * taken) / F.nullif(F.sum(F.col("__v") * F.col("__c")), F.lit(0.0))).alias(out))
