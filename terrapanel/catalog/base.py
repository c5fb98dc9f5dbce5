"""Registry, driver-table views and the SQL text they correspond to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.operators import grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can express it, its oracle."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Tables(spark, sf_dir)))
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so both engines report the same types."""
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; ``special`` overrides the digits of single columns (None keeps)."""
    def one(c, t):
        d = special.get(c, digits)
        return F.round(c, d).alias(c) if t == "double" and d is not None else F.col(c)
    return df.select(*[one(c, t) for c, t in df.dtypes])


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- transactions: line items sold by an area (supplier) ---
    @property
    def tx(self) -> DataFrame:
        return self.lineitem.select(
            "l_orderkey", "l_partkey", "l_linenumber", F.col("l_suppkey").alias("area_id"),
            F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"),
            F.col("l_shipdate").alias("sold_at"), F.to_date("l_shipdate").alias("sold_on"), F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
            F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"))

    @property
    def areas(self) -> DataFrame:
        return (self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
                .select(F.col("s_suppkey").alias("area_id"), F.col("s_nationkey").alias("district_id"),
                        F.col("n_regionkey").alias("region_id"), F.col("s_acctbal").alias("income")))

    # --- area by year panel: outcome y, counts, baseline, treatment rate and its lag x ---
    @property
    def cells(self) -> DataFrame:
        return self.tx.groupBy("area_id", "year").agg(
            F.count(F.lit(1)).alias("n"), F.ln(F.avg(F.col("price") / F.col("size"))).alias("y"),
            F.count_if(F.col("kind") == "R").alias("built"))

    @property
    def baseline(self) -> DataFrame:
        return self.tx.where("year = 1995").groupBy("area_id").agg(F.count(F.lit(1)).alias("base"))

    @property
    def panel_all(self) -> DataFrame:
        rate = F.lit(1000.0) * F.col("built") / F.col("base")
        p = (self.cells.join(self.baseline, "area_id").withColumn("rate", rate))
        p = grid.add_lags(p, "area_id", "year", ["rate"], [1]).withColumnRenamed("rate_lag1", "x")
        return p.join(self.areas, "area_id")

    @property
    def panel(self) -> DataFrame:
        """The estimation panel: years with a defined lag (1996 on)."""
        return self.panel_all.where("year >= 1996")

    # --- points: deterministic planar coordinates in metres ---
    @property
    def points(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.supplier.select(k.alias("area_id"), F.pmod(k * 7919, F.lit(100000)).cast("double").alias("px"),
                                    F.pmod(k * 104729, F.lit(100000)).cast("double").alias("py"))

    @property
    def certs(self) -> DataFrame:
        return self.events.select("event_id", F.col("user_id").alias("dwelling_id"), F.to_date("ts").alias("lodged_on"),
                                  F.col("event_type").alias("kind"), F.col("value").alias("floor_area"))


TX = """tx AS (SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey AS area_id, l_extendedprice AS price,
 l_quantity AS size, CAST(l_shipdate AS DATE) AS sold_on, CAST(year(l_shipdate) AS BIGINT) AS year,
 CAST(month(l_shipdate) AS BIGINT) AS month, l_returnflag AS kind, l_linestatus AS status FROM lineitem)"""

AREAS = """areas AS (SELECT s_suppkey AS area_id, CAST(s_nationkey AS BIGINT) AS district_id,
 CAST(n_regionkey AS BIGINT) AS region_id, s_acctbal AS income FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PANEL = f"""{TX}, {AREAS},
cells AS (SELECT area_id, year, count(*) AS n, ln(avg(price / size)) AS y,
 count(*) FILTER (WHERE kind = 'R') AS built FROM tx GROUP BY ALL),
baseline AS (SELECT area_id, count(*) AS base FROM tx WHERE year = 1995 GROUP BY ALL),
panel_all AS (SELECT c.*, b.base, CAST(1000.0 AS DOUBLE) * built / base AS rate,
 lag(CAST(1000.0 AS DOUBLE) * built / base) OVER (PARTITION BY c.area_id ORDER BY year) AS x,
 a.district_id, a.region_id, a.income
 FROM cells c JOIN baseline b ON c.area_id = b.area_id JOIN areas a ON c.area_id = a.area_id),
panel AS (SELECT * FROM panel_all WHERE year >= 1996)"""

POINTS = """points AS (SELECT s_suppkey AS area_id, CAST((s_suppkey * 7919) % 100000 AS DOUBLE) AS px,
 CAST((s_suppkey * 104729) % 100000 AS DOUBLE) AS py FROM supplier)"""

CERTS = """certs AS (SELECT event_id, user_id AS dwelling_id, CAST(ts AS DATE) AS lodged_on, event_type AS kind,
 value AS floor_area FROM events)"""
