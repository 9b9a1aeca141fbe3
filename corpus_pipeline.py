"""The corpus pipeline: drop texts of no language, drop toxic texts, keep one of each near-duplicate group, pack the rest.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and gives a DataFrame that is
written as Parquet and read again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, ngram_join, packing, toxicity
from lodestar.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language model rejects: texts that are null or have no letter."""
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the lexicon scores as toxic, at its threshold of 0.7."""
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), lexicon).where("predicted = 0").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each component of texts whose shingle sets have a Jaccard similarity of 0.75 or more.

    Rows without shingles and rows with a null doc_id are in no group and stay. A document is a doc_id: its rows stay or
    go together.
    """
    groups = ngram_join.similar_documents(docs).where("n_shingles > 0 AND doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(groups, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences, neighbours on the curve together."""
    return packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language", language), ("clean", clean), ("distinct", distinct), ("pack", pack)]
#: SQL can't express the trained models and the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
