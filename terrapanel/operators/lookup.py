"""Lookup joins that preserve fact rows, and the checks that guard them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.operators.joins import all_of


def unique_lookup(lookup: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct lookup rows: repeated identical rows must not fan a join out."""
    return lookup.select(*columns).distinct()


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str | None = None,
                matched: str | None = None, normalise: bool = False) -> DataFrame:
    """Left join on one key, optionally upper/trimmed on the fact side, flagging matches."""
    lookup_key = lookup_key or key
    right = lookup.withColumnRenamed(lookup_key, "__lk").withColumn("__hit", F.lit(True))
    left = F.upper(F.trim(F.col(key))) if normalise else F.col(key)
    joined = df.withColumn("__fk", left).join(right, F.col("__fk") == F.col("__lk"), "left")
    if matched:
        joined = joined.withColumn(matched, F.coalesce(F.col("__hit"), F.lit(False)))
    return joined.drop("__fk", "__lk", "__hit")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str], what: str = "lookup") -> DataFrame:
    """Return ``df`` unchanged, or stop when a key repeats."""
    first = duplicate_keys(df, keys).limit(1).collect()
    if first:
        raise ValueError(f"{what}: duplicate key {first[0].asDict()}")
    return df


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], validate: str = "m:1",
                   how: str = "left") -> DataFrame:
    """Join after proving the stated cardinality ('m:1' or '1:1')."""
    if validate not in ("m:1", "1:1"):
        raise ValueError(f"unknown cardinality {validate!r}")
    require_unique(right, keys, "right side")
    if validate == "1:1":
        require_unique(left, keys, "left side")
    return left.join(right, keys, how)


def match_rate(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    hit = F.col(column).isNotNull()
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_matched"),
        F.avg(hit.cast("double")).alias("match_rate"))


def require_match_rate(df: DataFrame, column: str, floor: float) -> float:
    rate = match_rate(df, column).first()["match_rate"]
    if rate is None or rate < floor:
        raise ValueError(f"match rate of {column} is {rate}, below {floor}")
    return rate


def most_common_parent(df: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """One row per child: its most frequent parent tuple, ties to the smallest tuple."""
    counts = (df.where(all_of([F.col(p).isNotNull() for p in parents]))
              .groupBy(child, *parents).agg(F.count(F.lit(1)).alias("__n")))
    best = counts.groupBy(child).agg(F.min(F.struct((-F.col("__n")).alias("o"), *parents)).alias("__b"))
    return best.select(child, *[F.col(f"__b.{p}").alias(p) for p in parents])


def side_indicator(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both tables labelled both / left_only / right_only."""
    a = left.select(F.col(key)).distinct().withColumn("__a", F.lit(1))
    b = right.select(F.col(key)).distinct().withColumn("__b", F.lit(1))
    label = (F.when(F.col("__a").isNull(), "right_only").when(F.col("__b").isNull(), "left_only")
             .otherwise("both"))
    return a.join(b, key, "full_outer").select(key, label.alias("side"))


def universe_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only on the left, only on the right, shared."""
    s = side_indicator(left, right, key)
    return s.agg(*[F.count_if(F.col("side") == v).alias(f"n_{v}")
                   for v in ("left_only", "right_only", "both")])


def nesting_report(df: DataFrame, child: str, parent: str) -> DataFrame:
    """One row: children, children with several parents, children without any."""
    per = df.groupBy(child).agg(F.min(parent).alias("lo"), F.max(parent).alias("hi"))
    return per.agg(F.count(F.lit(1)).alias("n_children"),
                   F.count_if(F.col("lo") != F.col("hi")).alias("n_not_nested"),
                   F.count_if(F.col("lo").isNull()).alias("n_without_parent"))


def split_weight(pieces: DataFrame, source: str, target: str, weight: str, out: str) -> DataFrame:
    """Share a source's weight equally over its distinct pieces, then total by target."""
    pairs = pieces.groupBy(source, target).agg(F.max(weight).alias("__w"))
    size = pairs.groupBy(source).agg(F.count(F.lit(1)).alias("__k"))
    return (pairs.join(size, source).groupBy(target)
            .agg(F.sum(F.col("__w") / F.col("__k")).alias(out)))


def code_relationship(links: DataFrame, old: str, new: str) -> DataFrame:
    """Per link row: unchanged, split, merged, complex, or unlinked."""
    pairs = links.select(old, new).distinct()
    n_new = pairs.groupBy(old).agg(F.count(F.col(new)).alias("n_new"))
    n_old = pairs.groupBy(new).agg(F.count(F.col(old)).alias("n_old"))
    one, many = F.col("n_new") == 1, F.col("n_new") > 1
    kind = (F.when(F.col(new).isNull(), "unlinked")
            .when(one & (F.col("n_old") == 1) & (F.col(old) == F.col(new)), "unchanged")
            .when(one & (F.col("n_old") == 1), "recoded")
            .when(many & (F.col("n_old") == 1), "split")
            .when(one & (F.col("n_old") > 1), "merged").otherwise("complex"))
    return (pairs.join(n_new, old, "left").join(n_old, new, "left")
            .select(old, new, "n_new", "n_old", kind.alias("relationship")))


def share_within(df: DataFrame, count: str, by: list[str], out: str) -> DataFrame:
    """count / group total on an already aggregated table."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(out, F.col(count) / F.sum(count).over(w))
