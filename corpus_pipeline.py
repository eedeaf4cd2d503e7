"""Corpus pipeline: stages over documents, each on all that its predecessor wrote.

1. language: documents without a language that holds half of their letters go.
2. near_duplicates: of each group of linked fingerprints the smallest id stays.
3. substrings: repeated 50-byte strings are cut out; documents of which nothing is left go.
4. benchmark: documents with an occurrence of a benchmark window go.
5. packing: what is left becomes token windows.

Rows that share an id are one document where a stage decides by id; a null id
is an id like any other. Empty tables pass through every stage, and columns of
any other name come along to the packing. near_duplicates takes the links of
op3's contract (fingerprints of 4-word shingles, 4 bits).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberloom.llm import decontaminate, langid, packing, simhash, suffix_dedup
from emberloom.llm.common import materialise, table

#: Ids that are broadcast at most.
LISTED = 500_000


def without(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """docs whose id is not among ids. These are written first and counted: up to LISTED of them are broadcast, so that texts
    don't move; more are joined."""
    gone = materialise(ids.select(F.col("doc_id").alias("gone")), label)
    listed = F.broadcast(gone) if gone.count() <= LISTED else gone
    return docs.join(listed, docs["doc_id"].eqNullSafe(listed["gone"]), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(docs.where(~langid.is_held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(docs)
    stays = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    return without(docs, stays.where("not stays").select("doc_id"), "copies")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = suffix_dedup.repeated_substrings(docs, with_text=True, carry=others)
    left = found.where("n_bytes = 0 or kept <> ''")
    named = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    return left.select(*[(named[c] if c in named else F.col("carried")[c]).alias(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id").distinct(), "contaminated")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", benchmark),
    ("packing", packed),
]

#: SQL can express neither the language model nor the tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
