"""Row numbers, n-tiles and quartile rules over a distributed sort.

A window over a huge group would pull all of it into one task. Rows are range partitioned on
(group, order), numbered locally, and shifted by the sizes of earlier partitions; a heavy group or
a heavily tied value spans as many partitions as it needs, and there is one plan for any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.joins import attach
from terrapanel.session import materialise

_LOCAL = (1 << 33) - 1


def with_row_numbers(df: DataFrame, by: list[str], order: list[Column], number: str = "row_num", size: str = "group_n") -> DataFrame:
    """Add the 1-based number of each row within its group, and the group's size. ``order`` must be a total order."""
    keys = [F.col(c).asc_nulls_last() for c in by] + list(order)
    numbered = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .withColumn("__tp_part", F.spark_partition_id())
                .withColumn("__tp_seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))))
    stored = materialise(numbered)
    # one number a partition
    sizes = {r[0]: r[1] for r in stored.groupBy("__tp_part").count().collect()}
    before, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    shift = F.get(F.lit(before).cast("array<bigint>"), F.col("__tp_part")) if before else F.lit(0).cast("bigint")
    placed = stored.withColumn("__tp_pos", shift + F.col("__tp_seq")).drop("__tp_part", "__tp_seq")
    if not by:
        return placed.withColumns({size: F.lit(total).cast("bigint"), number: F.col("__tp_pos") + 1}).drop("__tp_pos")
    starts = placed.groupBy(*by).agg(F.min("__tp_pos").alias("__tp_start"), F.count(F.lit(1)).alias(size))
    return (attach(placed, starts, by)
            .withColumn(number, F.col("__tp_pos") - F.col("__tp_start") + 1).drop("__tp_pos", "__tp_start"))


def ntile_of(row_num: Column, n: Column, k: int) -> Column:
    """SQL NTILE: the first n mod k tiles take one extra row."""
    base, extra = F.floor(n / k), n % k
    head = extra * (base + 1)
    return F.when(row_num <= head, F.floor((row_num - 1) / (base + 1)) + 1).otherwise(
        extra + F.floor((row_num - 1 - head) / F.greatest(base, F.lit(1))) + 1)


def spread_quantile_of(row_num: Column, n: Column, k: int) -> Column:
    """ceil(rank*k/n): the remainder is spread over the groups instead of leading them."""
    return F.floor((row_num * k + n - 1) / n)


def rank_bin_of(row_num: Column, n: Column, k: int) -> Column:
    """Quantile-edge bin of a unique rank 1..n (right-closed, lowest included)."""
    width = (n - 1) / F.lit(float(k))
    return F.greatest(F.lit(1), F.ceil((row_num - 1) / F.nullif(width, F.lit(0.0)))).cast("long")


def with_tile(df: DataFrame, value: str, key: str, k: int, out: str, rule: str = "ntile",
              by: list[str] | None = None) -> DataFrame:
    """k equal-count groups in ascending ``value``; ties broken by ``key``. NULL values get NULL."""
    by = by or []
    rules = {"ntile": ntile_of, "spread": spread_quantile_of, "rank_bin": rank_bin_of}
    valid = df.where(F.col(value).isNotNull())
    numbered = with_row_numbers(valid, by, [F.col(value).asc(), F.col(key).asc()], "__tp_row", "__tp_n")
    tiled = numbered.withColumn(out, rules[rule](F.col("__tp_row"), F.col("__tp_n"), k).cast("long"))
    missing = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("long"))
    return tiled.drop("__tp_row", "__tp_n").unionByName(missing)
