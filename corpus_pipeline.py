"""A corpus from raw documents to token ids: five stages, each a table of the whole of what the one before kept.

Every stage but the last returns the columns of ``documents``. A row of ``documents`` with null columns, an empty or very long text, an
id that repeats or an empty table passes through all stages as the operators define; extra columns are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import bpe, langid, mixing, pii
from terrapanel.llm.common import checked
from terrapanel.llm.ngram_join import similar_components
from terrapanel.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The key of the surrogates; a deployment passes its own.
PII_KEY = "corpus"

#: Rows of a batch that goes to a Python worker: whole texts, of which a task holds few at a time.
BATCH_ROWS = "1000"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: rows whose text has no letter, or whose two nearest codewords are about as near, go.

    The stage learns from the rows that ``langid.held_out`` leaves. ``lang`` stays as it was.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    found = langid.identify(docs, ~langid.held_out(), keep=COLUMNS[1:])
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: of each group of linked rows the one with the smallest id stays.

    Rows are told apart by id and text together, so an id that stands on different texts takes part once for each of them. A row with a
    null id stays only if no row of its group has an id; of rows with one id, or none, the one with the smallest hash of its text. Of
    rows with one id and one text, one stays. A row without words is a group of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    marked = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("mark"))
    rows = materialise(similar_components(marked, key="mark", size=5, percent=80))
    groups = rows.groupBy("mark").agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("copies"))
    groups = materialise(groups.join(marked.groupBy("mark").agg(F.min("doc_id").alias("doc_id")), "mark"))
    first = materialise(groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")).alias("w")).select("component_id", F.col("w.mark").alias("stays")))
    gone = materialise(groups.join(checked(first), "component_id").where("mark <> stays").select("mark"))
    again = materialise(groups.where("copies > 1").select("mark"))
    kept = marked.join(checked(gone), "mark", "left_anti")
    single = kept.join(checked(again), "mark", "left_anti")
    repeated = kept.join(checked(again), "mark", "left_semi").dropDuplicates(["mark"])
    return single.select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` counts the new text."""
    out = pii.pseudonymise(docs.select(*COLUMNS), PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the Pfair schedule of their sources: files follow one another by position, as do rows in a file."""
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids as little-endian unsigned 32-bit integers, in the order of the mixture.

    ``docs`` is the written table of the mixture. Spark reads files by size, so its rows are put back in order by the number in the name of
    their file and their place in it; this table's files follow one another by name too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    name = F.col("_metadata.file_name")
    placed = docs.select("doc_id", "text", F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long").alias("file"), name.alias("name"), F.col("_metadata.row_index").alias("row"))
    return bpe.encode(placed.orderBy("file", "name", "row"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("surrogates", surrogates), ("mixture", mixture), ("tokens", tokens)]
#: SQL cannot express the tokenizer or the trained classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
