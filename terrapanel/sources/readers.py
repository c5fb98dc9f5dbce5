"""Readers. Schemas are explicit or all-string; nothing is guessed about columns a caller needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month tokens of the monthly index file.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def columns_for(present: list[str], wanted: dict[str, str], what: str = "table") -> dict[str, str]:
    """The column of ``present`` for each wanted name, given exactly or, ending in ``*``, by how it begins.

    Everything missing or ambiguous is reported in one error.
    """
    found = {name: [c for c in present if (c.startswith(rule[:-1]) if rule.endswith("*") else c == rule)] for name, rule in wanted.items()}
    wrong = {wanted[name]: hits for name, hits in found.items() if len(hits) != 1}
    if wrong:
        raise KeyError(f"{what}: no single column for {wrong}; there are {present}")
    return {name: hits[0] for name, hits in found.items()}


def with_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    """``df``, if it has all these columns."""
    columns_for(df.columns, dict(zip(names, names)), what)
    return df


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def csv(spark: SparkSession, path: str | list[str], schema: str | None = None, needed: list[str] | None = None) -> DataFrame:
    """CSV with header. With a ``schema`` values are typed in one pass; without, types are inferred."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return with_columns(df, needed or [], str(path))


def csv_strings(spark: SparkSession, path: str | list[str], needed: list[str] | None = None) -> DataFrame:
    """Every column as text, so code columns keep their leading zeros."""
    df = strip_headers(spark.read.option("header", True).option("inferSchema", False).csv(path))
    return with_columns(df, needed or [], str(path))


def union_by_name(spark: SparkSession, paths: list[str], needed: list[str]) -> DataFrame:
    """Files of one collection with differing column order, united by column name."""
    parts = [csv_strings(spark, p, needed) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def monthly_index(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (period, value) file: only rows such as '2015 JAN' are months; preamble,
    annual and quarterly rows have no month token and drop out."""
    raw = spark.read.schema("period string, value string").csv(path)
    token = F.upper(F.split_part("period", F.lit(" "), F.lit(2)))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), token)
    return (raw.where(month > 0)
            .select(F.split_part("period", F.lit(" "), F.lit(1)).try_cast("int").alias("year"), month.cast("int").alias("month"),
                    F.col("value").cast("double").alias("idx")))


def preamble_table(spark: SparkSession, path: str, header_prefix: str, body_prefix: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Text table behind free-form lines: the header is the first line whose first cell starts with
    ``header_prefix``; body rows start with ``body_prefix``. Only the header line reaches the driver."""
    lines = (spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "")
             .schema("line string").csv(path))
    plain = F.regexp_replace(F.lower(F.ltrim("line")), '^"', "")
    found = lines.where(plain.startswith(header_prefix.lower())).limit(1).collect()
    if not found:
        raise KeyError(f"{path}: no header starting with {header_prefix!r}")
    names = [c.strip().strip('"') for c in found[0]["line"].split(",")]
    schema = ", ".join(f"`{c}` string" for c in names)
    body = lines.where(F.regexp_replace("line", '^"', "").startswith(body_prefix))
    return body.select(F.from_csv("line", F.lit(schema)).alias("r")).select("r.*")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return with_columns(df, columns, path).select(*columns) if columns else df


def schema_inventory(df: DataFrame, name: str) -> DataFrame:
    """One row per column (position, column, type) with the table's row count."""
    cols = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"))
                     for i, (c, t) in enumerate(df.dtypes)])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), F.inline(cols), "n_rows")


def records(spark: SparkSession, path: str | list[str], start: str) -> DataFrame:
    """(value): the JSON texts of the records of large documents, one row each, read by as many tasks as the files have splits.

    ``start`` is how every record begins in the files, to the letter, and nothing else does, as in ``{"type":"Feature"``. What follows a record up to the next
    stays in its text, where ``from_json`` does not look. A file without any record stops the read.
    """
    text = spark.read.option("lineSep", start).text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_size").alias("__size"))
    per = text.groupBy("__file").agg(F.count(F.lit(1)).alias("n"), F.max("__size").alias("size"))
    empty = per.where((F.col("n") < 2) & (F.col("size") > 0)).agg(F.min("__file")).first()[0]
    if empty is not None:
        raise ValueError(f"no record of {empty} starts with {start!r}")
    # what stands before the first record of a file holds no whole record
    return text.select(F.concat(F.lit(start), "value").alias("value"))


def observations(spark: SparkSession, path: str | list[str], dimensions: int, start: str | None = None) -> DataFrame:
    """Nested observation documents -> (dim0.., value) rows: one file per task, or by records that begin with ``start`` (:func:`records`)."""
    one = "struct<dimensions: array<struct<option_id: string>>, observation: bigint>"
    if start is None:
        found = spark.read.option("multiLine", True).schema(f"observations array<{one}>").json(path).select(F.explode("observations").alias("o"))
    else:
        found = records(spark, path, start).select(F.from_json("value", one).alias("o")).where("o.dimensions IS NOT NULL")
    return found.select(*[F.col("o.dimensions")[i]["option_id"].alias(f"dim{i}") for i in range(dimensions)], F.col("o.observation").alias("value"))


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def geojson(spark: SparkSession, path: str | list[str], code: str, lines: bool = False, start: str | None = None) -> DataFrame:
    """Features -> (code, kind, x, y, rings); coordinates must already be projected metres.

    ``lines`` reads one feature per line, which Spark can split; a collection is one task per file, or is split at the features if ``start`` says how they begin
    (:func:`records`).
    """
    feature = f"properties struct<`{code}`: string>, geometry struct<type: string, coordinates: string>"
    if lines:
        f = spark.read.schema(feature).json(path)
    elif start is not None:
        whole = "struct<" + feature.replace("properties struct", "properties: struct").replace(", geometry struct", ", geometry: struct") + ">"
        f = records(spark, path, start).select(F.from_json("value", whole).alias("f")).select("f.*").where("geometry IS NOT NULL")
    else:
        nested = feature.replace("properties struct", "properties: struct").replace(", geometry struct", ", geometry: struct")
        raw = spark.read.option("multiLine", True).schema(f"features array<struct<{nested}>>").json(path)
        f = raw.select(F.inline("features"))
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    ring = "array<array<array<double>>>"
    polygon, multi = F.from_json(text, ring), F.flatten(F.from_json(text, f"array<{ring}>"))
    rings = F.when(kind == "Polygon", F.transform(polygon, _points)).when(kind == "MultiPolygon", F.transform(multi, _points))
    point = F.when(kind == "Point", F.from_json(text, "array<double>"))
    return f.select(F.col(f"properties.{code}").alias("code"), kind.alias("kind"), point[0].alias("x"), point[1].alias("y"), rings.alias("rings"))


def split_composite(df: DataFrame, column: str, code: str, name: str) -> DataFrame:
    """'E02000001 : City of London 001' style cells into code and name."""
    return df.withColumns({code: F.trim(F.split_part(column, F.lit(":"), F.lit(1))), name: F.trim(F.regexp_extract(column, r"^[^:]*:(.*)$", 1))})


def census_long(spark: SparkSession, path: str | list[str], key: str, category: str, value: str, prefix: str, columns: dict[str, str]) -> DataFrame:
    """Long code/category/value file filtered by code prefix and pivoted to one row per code."""
    from terrapanel.operators.indexing import long_to_wide
    raw = csv_strings(spark, path, [key, category, value])
    rows = raw.where(F.col(key).startswith(prefix)).withColumn(value, F.col(value).cast("long"))
    return long_to_wide(rows, key, category, value, columns)
