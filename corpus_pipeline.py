"""A training-data pipeline over ``documents``: language ID, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm import fastsketch, langid, mixing, packing, toxicity
from assayloom.llm.common import shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose likeliest hypothesis, by text, declared language and source together, is no language."""
    return langid.keep_identified(docs, docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored as toxic by a model trained on the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=lambda c: F.lit(False)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document of smallest id, one row of each of its texts."""
    kept = fastsketch.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    nameless = docs.filter("doc_id is null")
    mark = "_".join(["text", *docs.columns])  # a name no column has
    once = docs.join(kept, "doc_id", "left_semi").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark])
    return once.select(docs.columns).union(nameless)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics come near their tempered shares."""
    return mixing.keep_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

#: Trained models and sketches can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
