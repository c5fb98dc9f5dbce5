"""Event de-duplication and forward lookups.

Forward lookups first collapse the later records to one row per (key, day). That bounds every
key by the number of days in the data, so a key holding a large share of all rows still fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.operators.joins import attach


def _nulls_last(columns: list[str]) -> list[Column]:
    out = []
    for i, c in enumerate(columns):
        out += [F.col(c).isNull().alias(f"__null{i}"), F.col(c).alias(f"__ord{i}")]
    return out


def first_record(df: DataFrame, key: str, order: list[str], tiebreak: str) -> DataFrame:
    """Earliest record per key (NULL dates last, then ``tiebreak``); rows without key or first date
    are dropped. An ordered-minimum aggregate combines map-side, so hot keys cost nothing extra."""
    payload = [c for c in df.columns if c != key]
    usable = df.where(F.col(key).isNotNull() & F.col(order[0]).isNotNull())
    picked = usable.groupBy(key).agg(
        F.min_by(F.struct(*payload), F.struct(*_nulls_last([*order, tiebreak]))).alias("__row"))
    return picked.select(key, *[F.col(f"__row.{c}").alias(c) for c in payload])


def first_where(df: DataFrame, by: list[str], value: str, order: str, tiebreak: str,
                test: Column, out: str) -> DataFrame:
    """first(value ORDER BY order, tiebreak) FILTER (test), per group; NULL orderings are skipped."""
    rank = F.when(test & F.col(order).isNotNull(), F.struct(order, tiebreak))
    return df.groupBy(*by).agg(F.min_by(F.col(value), rank).alias(out))


def daily_first(df: DataFrame, key: str, date: str, value: str, tiebreak: str) -> DataFrame:
    """(key, __day, __value): the first record of each key-day."""
    best = (df.where(F.col(key).isNotNull() & F.col(date).isNotNull())
            .groupBy(key, F.col(date).alias("__day"))
            .agg(F.min_by(F.col(value), F.struct(F.col(tiebreak))).alias("__value")))
    return best


def next_record(events: DataFrame, later: DataFrame, key: str, event_date: str, later_date: str,
                value: str, tiebreak: str, out: str, out_date: str, test: Column | None = None,
                months: int | None = None) -> DataFrame:
    """First later record (strictly after the event date, optionally within ``months``).

    Every event is kept; ``out``/``out_date`` are NULL where nothing qualifies. Works at key-day
    grain, so repeated events of one day share a lookup.
    """
    source = later.where(test) if test is not None else later
    marks = (events.where(F.col(key).isNotNull() & F.col(event_date).isNotNull())
             .select(key, F.col(event_date).alias("__day")).distinct()
             .withColumn("__want", F.lit(True)))
    found = daily_first(source, key, later_date, value, tiebreak).withColumn("__hit", F.lit(True))
    days = marks.join(found, [key, "__day"], "full_outer")
    # at most one row per calendar day within a key; descending, so the frame only ever grows
    ahead = (Window.partitionBy(key).orderBy(F.col("__day").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.last(F.when(F.col("__hit"), F.struct(F.col("__day").alias("d"), F.col("__value").alias("v"))),
                 ignorenulls=True).over(ahead)
    answers = days.withColumn("__n", nxt).where(F.col("__want"))
    if months is not None:
        inside = F.col("__n.d") <= F.add_months(F.col("__day"), months)
        answers = answers.withColumn("__n", F.when(inside, F.col("__n")))
    answers = answers.select(key, F.col("__day").alias(event_date), F.col("__n.v").alias(out),
                             F.col("__n.d").alias(out_date))
    return attach(events, answers, [key, event_date])


def fill_unknown(df: DataFrame, primary: str, found: str, unknown: str, out: str) -> DataFrame:
    """Robustness column: the looked-up value where the primary is unknown; primary untouched."""
    return df.withColumn(out, F.when((F.col(primary) == unknown) & F.col(found).isNotNull(), F.col(found))
                         .otherwise(F.col(primary)))


def dedup_summary(df: DataFrame, key: str, date: str) -> DataFrame:
    """One row: records, records without key, without date, unique keys, repeats collapsed."""
    usable = F.col(key).isNotNull() & F.col(date).isNotNull()
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(date).isNull()).alias("no_date"),
        F.count_if(usable).alias("ok"))
    no_key = F.col(key).isNull()
    return per_key.agg(
        F.sum("n").alias("n_records"),
        F.coalesce(F.sum(F.when(no_key, F.col("n"))), F.lit(0)).alias("n_missing_key"),
        F.coalesce(F.sum(F.when(~no_key, F.col("no_date"))), F.lit(0)).alias("n_missing_date"),
        F.count_if(F.col("ok") > 0).alias("n_unique"),
        (F.sum("ok") - F.count_if(F.col("ok") > 0)).alias("n_collapsed"))
