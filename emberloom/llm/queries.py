"""The opN_ queries: each operator on its whole table, reduced to the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, langid, licenses, packing, parsing, simhash, suffix_dedup, token_count
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; theirs are source, thousands and hundreds of the id,
    where a round id is the licence file of the directory above. Any document that states a
    license states it for its directory."""
    d = F.col("doc_id")
    place = F.when(d % 1000 == 0, F.array("source")).when(d % 100 == 0, F.array(F.col("source"), F.expr("cast(doc_id div 1000 as string)"))).otherwise(
        F.array(F.col("source"), F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)"))
    )
    path = F.concat(F.array_join(place, "/"), F.when(d % 100 == 0, "/LICENSE.").otherwise("/"), F.coalesce(d.cast("string"), F.lit("")), F.lit(".txt"))
    files = table(spark, sf_dir, "documents").select(d.alias("key"), path.alias("path"), "text")
    return licenses.scan(files, every_statement=True).withColumnRenamed("key", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.conversations(chat.events_of_rows(rows.unionByName(probe))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.select("*", langid.is_held_out().alias("held_out"))
    model = langid.fit(held.where("not held_out"))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_substrings(table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_licenses, op3_simhash, op4_chat_format, op5_language_id, op6_suffix_dedup, op7_packing, op8_token_counts, op9_fingerprints, op10_html_text)}
ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op2_licenses": licenses.ORACLE, "op4_chat_format": chat.ORACLE, "op6_suffix_dedup": suffix_dedup.ORACLE}
