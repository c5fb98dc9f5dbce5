"""Sources and sinks, exercised by round trips of data derived from the driver tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from terrapanel.catalog.base import PANEL, TX, query, rounded
from terrapanel.catalog.spatial import CELLS, shapes
from terrapanel.plans.final_panel import regression_slice
from terrapanel.plans.spec_registry import recorded_fit
from terrapanel.session import materialise, shared_dir
from terrapanel.sources import readers, writers


def fresh(t, name: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/terrapanel/io-{name}-{uuid.uuid4().hex}"


SUPPLIERS = "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"


@query("s01_csv_inferred", SUPPLIERS)
def s01(t):
    path = fresh(t, "s01")
    writers.write_csv(t.supplier, path)
    return readers.csv(t.spark, path, needed=["s_suppkey"]).withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query("s01_csv_explicit_schema", SUPPLIERS)
def s01b(t):
    path = fresh(t, "s01b")
    writers.write_csv(t.supplier, path)
    return readers.csv(t.spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("s02_csv_strings", "SELECT lpad(s_suppkey::VARCHAR, 8, '0') AS code, s_name FROM supplier")
def s02(t):
    path = fresh(t, "s02")
    writers.write_csv(t.supplier.select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias(" code "), "s_name"), path)
    return readers.csv_strings(t.spark, path, ["code"])


@query("s03_union_by_name", "SELECT s_suppkey::VARCHAR AS k, s_name AS name, CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey::VARCHAR END AS nation FROM supplier")
def s03(t):
    a, b = fresh(t, "s03a"), fresh(t, "s03b")
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    writers.write_csv(s.where("k % 2 = 0").select("name", "k"), a)
    writers.write_csv(s.where("k % 2 = 1").select("k", "nation", "name"), b)
    return readers.union_by_name(t.spark, [a, b], ["k", "name"]).select("k", "name", "nation")


@query("s04_monthly_index", f"WITH {TX} SELECT year, month, 100.0::DOUBLE + count(*) AS idx FROM tx GROUP BY ALL")
def s04(t):
    path = fresh(t, "s04")
    m = t.tx.groupBy("year", "month").agg((100.0 + F.count(F.lit(1))).alias("v"))
    token = F.element_at(F.array(*[F.lit(x) for x in readers.MONTHS]), F.col("month"))
    months = m.select(F.concat_ws(" ", F.col("year").cast("string"), token).alias("p"), F.col("v").cast("string").alias("v"))
    years = m.select(F.col("year").cast("string").alias("p"), F.lit("1").alias("v")).distinct()
    quarters = years.select(F.concat("p", F.lit(" Q1")).alias("p"), "v")
    (months.unionByName(years).unionByName(quarters).unionByName(years.select(F.lit("Title").alias("p"), F.lit("CPI index").alias("v")))).write.csv(path)
    return readers.monthly_index(t.spark, path)


@query("s05_preamble_table", "SELECT s_suppkey::VARCHAR AS area_code, s_name AS name, round(s_acctbal, 2) AS value FROM supplier")
def s05(t):
    path = fresh(t, "s05")
    from terrapanel.functions.expressions import number_from_text
    head = t.supplier.select(F.explode(F.array(F.lit("Table 1"), F.lit("notes, revised"), F.lit("Area_Code, name ,value (1)"))).alias("line"), F.monotonically_increasing_id().alias("i"))
    body = t.supplier.select(F.concat(F.lit("E01_"), F.col("s_suppkey").cast("string"), F.lit(","), F.col("s_name"), F.lit(',"'), F.format_number("s_acctbal", 2), F.lit('"')).alias("line"))
    head.where("i < 3").select("line").distinct().unionByName(body).write.text(path)
    raw = readers.preamble_table(t.spark, path, "area_code", "E01_")
    value = readers.columns_for(raw.columns, {"value": "value*"})["value"]
    return raw.select(F.regexp_replace("Area_Code", "^E01_", "").alias("area_code"), "name", number_from_text(F.col(f"`{value}`")).alias("value"))


@query("s06_parquet_projection", "SELECT o_orderkey, o_orderstatus FROM orders")
def s06(t):
    return readers.parquet(t.spark, f"{t.dir}/orders.parquet", ["o_orderkey", "o_orderstatus"])


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("s08_schema_inventory", f"""WITH n AS ({' UNION ALL '.join(f"SELECT '{t}' AS t, count(*) AS n_rows FROM {t}" for t in TABLES)}),
c AS ({' UNION ALL '.join(f"SELECT '{t}' AS t, row_number() OVER () AS position, column_name, column_type FROM (DESCRIBE {t})" for t in TABLES)})
SELECT c.t AS "table", position, column_name AS "column", CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
 WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(column_type) END AS type, n_rows FROM c JOIN n ON c.t = n.t""")
def s08(t):
    out = None
    for name in TABLES:
        part = readers.schema_inventory(getattr(t, name), name)
        out = part if out is None else out.unionByName(part)
    return out


@query("s09_nested_observations", "SELECT c_nationkey::VARCHAR AS dim0, c_mktsegment AS dim1, count(*) AS value FROM customer GROUP BY ALL")
def s09(t):
    path = fresh(t, "s09")
    c = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("observation"))
    o = F.struct(F.array(F.struct(F.col("c_nationkey").cast("string").alias("option_id")), F.struct(F.col("c_mktsegment").alias("option_id"))).alias("dimensions"), "observation")
    # one document per nation
    c.groupBy("c_nationkey").agg(F.collect_list(o).alias("observations")).select("observations").write.option("maxRecordsPerFile", 1).json(path)
    return readers.observations(t.spark, path, 2, start='{"dimensions"')


@query("s10_geojson", f"WITH {CELLS} SELECT cell_id::VARCHAR AS code, 'Polygon' AS kind, 4000000.0::DOUBLE AS area FROM shapes")
def s10(t):
    from terrapanel.operators.spatial import shape_areas
    path = fresh(t, "s10")
    coords = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    shapes(t).select(F.struct(F.col("cell_id").cast("string").alias("CODE")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry")).write.json(path)
    g = readers.geojson(t.spark, path, "CODE", lines=True)
    return g.select("code", "kind").join(shape_areas(g, "code", "rings"), "code")


@query("s11_census_long", "SELECT 'E02_' || c_nationkey AS code, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1")
def s11(t):
    path = fresh(t, "s11")
    c = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("OBS_VALUE"))
    e = c.select(F.concat(F.lit("E02_"), F.col("c_nationkey").cast("string")).alias("GEOGRAPHY_CODE"), F.col("c_mktsegment").alias("CAT"), "OBS_VALUE")
    writers.write_csv(e.unionByName(e.withColumn("GEOGRAPHY_CODE", F.lit("W02_0"))), path)
    return readers.census_long(t.spark, path, "GEOGRAPHY_CODE", "CAT", "OBS_VALUE", "E02", {"BUILDING": "building", "MACHINERY": "machinery"}).withColumnRenamed("GEOGRAPHY_CODE", "code")


@query("s13_composite_column", "SELECT 'E' || c_custkey AS code, c_name AS name FROM customer")
def s13(t):
    raw = t.customer.select(F.concat(F.lit("E"), F.col("c_custkey").cast("string"), F.lit(" : "), F.col("c_name")).alias("area"))
    return readers.split_composite(raw, "area", "code", "name").select("code", "name")


@query("k01_parquet_zstd", "SELECT c_custkey, c_acctbal FROM customer")
def k01(t):
    path = fresh(t, "k01")
    writers.write_parquet(t.customer.select("c_custkey", "c_acctbal"), path)
    return readers.parquet(t.spark, path)


@query("k02_csv_copy", "SELECT c_custkey, c_acctbal FROM customer")
def k02(t):
    path = fresh(t, "k02")
    writers.write_csv(t.customer.select("c_custkey", "c_acctbal"), path)
    return readers.csv(t.spark, path, "c_custkey bigint, c_acctbal double")


@query("k03_ordered_write", f"WITH {TX} SELECT area_id, year, count(*) AS n FROM tx GROUP BY ALL")
def k03(t):
    path = fresh(t, "k03")
    writers.write_ordered(t.tx.groupBy("area_id", "year").agg(F.count(F.lit(1)).alias("n")), path, ["area_id", "year"])
    return readers.parquet(t.spark, path)


@query("k04_regression_slice", f"""WITH {PANEL} SELECT t.l_orderkey, t.l_linenumber, t.area_id, t.year, t.price, a.district_id, round(p.x, 6) AS x FROM tx t LEFT JOIN areas a ON t.area_id = a.area_id
 LEFT JOIN panel_all p ON t.area_id = p.area_id AND t.year = p.year""")
def k04(t):
    path = fresh(t, "k04")
    s = regression_slice(t.tx, t.areas, t.panel_all, "area_id", "year", ["l_orderkey", "l_linenumber", "area_id", "year", "price"], ["district_id"], ["x"])
    writers.write_parquet(s, path)
    return rounded(readers.parquet(t.spark, path), 6, price=None)


@query("k06_specification_registry", f"""WITH {PANEL}, w AS (SELECT x - avg(x) OVER (PARTITION BY area_id) AS x, rate - avg(rate) OVER (PARTITION BY area_id) AS r, y - avg(y) OVER (PARTITION BY area_id) AS y FROM panel)
SELECT 'lagged' AS spec, 'x' AS term, round(sum(x * y) / sum(x * x), 10) AS coef, count(*) AS n_obs, 'ok' AS status FROM w UNION ALL SELECT 'same_year', 'rate', round(sum(r * y) / sum(r * r), 10), count(*), 'ok' FROM w UNION ALL SELECT 'absorbed', 'constant', NULL, NULL, 'FAILED: LinAlgError'""")
def k06(t):
    path, panel = fresh(t, "k06"), materialise(t.panel.withColumn("constant", F.lit(1.0)))
    for spec, x in (("lagged", "x"), ("same_year", "rate"), ("absorbed", "constant")):
        try:
            recorded_fit(panel, path, spec, "y", [x], fes=[["area_id"]], cluster=[["district_id"]])
        except np.linalg.LinAlgError:
            pass
    return readers.parquet(t.spark, path).select("spec", "term", F.round("coef", 10).alias("coef"), "n_obs", "status")
