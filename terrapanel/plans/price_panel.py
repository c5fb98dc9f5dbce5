"""From raw sales to the area-by-year price panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.operators import clean
from terrapanel.operators.quantiles import exact_quantiles, long_values

MEASURES = ["price", "unit", "size"]


def between_days(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows of the days first..last. Compared in the column's own type, so the scan can skip files."""
    kind = dict(df.dtypes)[column]
    after = F.date_add(F.lit(last).cast("date"), 1)
    return df.where((F.col(column) >= F.lit(first).cast("date").cast(kind)) & (F.col(column) < after.cast(kind)))


def cleaned_sales(tx: DataFrame, first: str = "1995-01-01", last: str = "2001-12-31", excluded_kind: str = "R",
                  trim: tuple[float, float] | None = (0.005, 0.995), date: str = "sold_at") -> DataFrame:
    """Dated, established, valid sales with a unit price, trimmed inside each year."""
    dated = between_days(tx, date, first, last).where(F.col("kind") != excluded_kind)
    valid = clean.valid_measures(dated, {"price": 0.0, "size": 0.0})
    sales = valid.select("area_id", "year", "price", "size", "kind", "status",
                         (F.col("price") / F.col("size")).alias("unit"))
    return clean.trim_within(sales, ["year"], "unit", *trim) if trim else sales


def aggregate_panel(sales: DataFrame, thresholds: list[int]) -> DataFrame:
    """Counts, means, shares and quantiles per area and year."""
    keys = ["area_id", "year"]
    sums = [F.count(F.lit(1)).alias("sale_count"), F.avg("unit").alias("mean_unit"), F.avg(F.ln("unit")).alias("mean_log_unit"),
            F.avg((F.col("kind") == "A").cast("double")).alias("a_share"), F.avg((F.col("status") == "F").cast("double")).alias("f_share")]
    wanted = {"median_price": ("price", 0.5), "median_unit": ("unit", 0.5), "p25_unit": ("unit", 0.25), "p75_unit": ("unit", 0.75), "median_size": ("size", 0.5)}
    # one measure after the other, so that a task that counts values holds those of one
    long = reduce(DataFrame.unionByName, [long_values(sales, keys, [m]) for m in MEASURES])
    q = exact_quantiles(long, [*keys, "variable"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    label = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("variable") == c, F.col(label[p]))).alias(name) for name, (c, p) in wanted.items()])
    panel = sales.groupBy(*keys).agg(*sums).join(wide, keys)
    return clean.low_count_flags(panel.withColumn("log_median_unit", F.ln("median_unit")), "sale_count", thresholds)


def price_panel(tx: DataFrame, thresholds: list[int] | None = None, **cleaning) -> DataFrame:
    return aggregate_panel(cleaned_sales(tx, **cleaning), thresholds or [40, 50])
