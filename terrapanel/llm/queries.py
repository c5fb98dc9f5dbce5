"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from terrapanel.llm import ann, attribution, bpe, chat, hard_negatives, langid, lm, mixing, oracles, pii, secrets, source_audit, spotsigs
from terrapanel.llm.ngram_join import similar_components


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(spotsigs.with_edits(documents(spark, sf_dir)))


def op2_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), langid.held_out()
    return langid.identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(documents(spark, sf_dir), corpus_pipeline.PII_KEY)
    counts = [F.size(F.filter("pii_found", lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return out.select("doc_id", "text", *counts)


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.backoff_scores(documents(spark, sf_dir)).select("doc_id", "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir), size=3, percent=90)


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.format_chats(given.unionByName(added)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spot_signatures": op1_spot_signatures,
    "op2_offset_attribution": op2_offset_attribution,
    "op3_language_codes": op3_language_codes,
    "op4_trigram_secrets": op4_trigram_secrets,
    "op5_surrogates": op5_surrogates,
    "op6_bpe_automaton": op6_bpe_automaton,
    "op7_stupid_backoff": op7_stupid_backoff,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_pfair_mixing": op9_pfair_mixing,
    "op10_permutation_index": op10_permutation_index,
    "op11_source_audit": op11_source_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_formatting": op13_chat_formatting,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op4_trigram_secrets": oracles.SECRETS,
    "op7_stupid_backoff": oracles.BACKOFF,
    "op8_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op11_source_audit": oracles.SOURCE_AUDIT,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_chat_formatting": oracles.CHATS,
}
