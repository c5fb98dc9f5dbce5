"""Assertions and quality summaries over panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.joins import all_of


def key_report(df: DataFrame, keys: list[str], entity: str, period: str) -> DataFrame:
    """Panel balance in one two-level aggregate: rows, entities, periods, duplicates."""
    cell = df.groupBy(entity, period).agg(F.count(F.lit(1)).alias("c"))
    per_entity = cell.groupBy(entity).agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("periods"),
                                          F.sum(F.col("c") - 1).alias("repeats"), F.min(period).alias("lo"), F.max(period).alias("hi"))
    return per_entity.agg(F.sum("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_entities"),
                          F.min("periods").alias("min_periods"), F.max("periods").alias("max_periods"),
                          F.min("lo").alias("first_period"), F.max("hi").alias("last_period"), F.sum("repeats").alias("duplicate_keys"))


def require_counts(df: DataFrame, rows: int | None = None, distinct: dict[str, int] | None = None) -> DataFrame:
    got = df.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(f"d_{c}") for c in distinct or {}]).first()
    wrong = [f"rows {got['rows']} != {rows}"] if rows is not None and got["rows"] != rows else []
    wrong += [f"{c} {got[f'd_{c}']} != {n}" for c, n in (distinct or {}).items() if got[f"d_{c}"] != n]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def varying_attributes(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """(attribute, n_entities_varying): entities holding more than one value, NULL counted as a value.

    min <> max instead of distinct counts, so no row is expanded per column.
    """
    per = df.groupBy(entity).agg(*[
        (F.coalesce(F.min(c) != F.max(c), F.lit(False)) | (F.count(c).between(1, F.count(F.lit(1)) - 1))).alias(c)
        for c in columns])
    return per.agg(*[F.count_if(c).alias(c) for c in columns]).unpivot([], columns, "attribute", "n_entities_varying")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations): rows for which a rule is not true, all rules in one pass."""
    names = list(rules)
    counted = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    return counted.unpivot([], names, "rule", "n_violations")


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = [r.asDict() for r in violations(df, rules).where("n_violations > 0").collect()]
    if broken:
        raise ValueError(f"rules violated: {broken}")
    return df


def in_range(c: str, lo: float | None = None, hi: float | None = None) -> Column:
    v = F.col(c).cast("double")
    tests = [~F.isnan(v), F.abs(v) < F.lit(float("inf"))]
    tests += [v >= lo] if lo is not None else []
    tests += [v <= hi] if hi is not None else []
    return v.isNull() | all_of(tests)


def drop_exact_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Remove repeated identical rows; a key left with conflicting rows is an error."""
    unique = df.dropDuplicates()
    clash = unique.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"conflicting rows for key {clash[0].asDict()}")
    return unique


def identity_gaps(df: DataFrame, parts: list[str], total: str, by: list[str] | None = None) -> DataFrame:
    """Largest |sum of parts - total| and whether the identity holds everywhere."""
    s = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    gap = F.abs(s - F.col(total))
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.max(gap).cast("double").alias("max_gap"),
                                       F.bool_and(gap <= 1e-9).alias("holds"))


def missingness(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, variable, n_missing, share_missing) from one aggregate over all columns."""
    by = by or []
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = wide.unpivot([*by, "__n"], columns, "variable", "n_missing")
    return long.select(*by, "variable", "n_missing", (F.col("n_missing") / F.col("__n")).alias("share_missing"))


def build_difference(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, n_changed) between two builds matched on key, plus rows present in only one."""
    a = old.select(*keys, F.struct(*columns).alias("__a"))
    b = new.select(*keys, F.struct(*columns).alias("__b"))
    both = a.join(b, keys, "full_outer")
    here = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    counts = both.agg(F.count_if(F.col("__b").isNull()).alias("(removed rows)"), F.count_if(F.col("__a").isNull()).alias("(added rows)"),
                      *[F.count_if(here & ~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}"))).alias(c) for c in columns])
    return counts.unpivot([], counts.columns, "column", "n_changed")
