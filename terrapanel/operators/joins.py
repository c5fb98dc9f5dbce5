"""Join helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.session import materialise


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join per-group ``stats`` (unique on ``keys``) back to ``df``; NULL keys match NULL keys.

    The physical join is left to AQE, which broadcasts ``stats`` when its measured size is under
    the threshold and otherwise falls back to a sort-merge join with skew splitting. Without keys,
    ``stats`` is a single row.
    """
    if not keys:
        return with_scalars(df, stats)
    right = stats.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                         *[c for c in stats.columns if c not in keys])
    cond = all_of([F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return df.join(right, cond, how).drop(*[f"__r_{k}" for k in keys])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate as a scalar subquery: no join, no shuffle of ``df``."""
    value = one_row.select(F.struct(*one_row.columns)).scalar().alias("__scalars")
    return df.select("*", value).withColumns({c: F.col(f"__scalars.{c}") for c in one_row.columns}).drop("__scalars")


def with_replications(df: DataFrame, reps: int) -> DataFrame:
    """Every row once per replication number 0..reps-1."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int = 4096) -> DataFrame:
    """Inner equi-join whose heavy keys are dealt to a grid of tasks.

    A key with more than ``rows`` rows on a side is cut into parts of about that many; every part of its left rows meets every part of its right
    rows under a key of its own. Light keys are joined as they are. Only the counts of heavy keys, at most one in ``rows`` rows, are joined to both sides.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name)).where(F.col(name) > 1)

    heavy = materialise(counted(left, "__lp").join(counted(right, "__rp"), keys, "full").select(*keys, F.coalesce("__lp", F.lit(1)).alias("__lp"), F.coalesce("__rp", F.lit(1)).alias("__rp")))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        at = df.join(heavy, keys, "left").withColumns({"__n": F.coalesce(own, F.lit(1)), "__m": F.coalesce(other, F.lit(1))}).drop("__lp", "__rp")
        mine = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.col("__n")).cast("int")
        return at.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__m") - 1))).drop("__n", "__m")

    return dealt(left, "__lp", "__rp").join(dealt(right, "__rp", "__lp"), [*keys, "__lp", "__rp"]).drop("__lp", "__rp")
