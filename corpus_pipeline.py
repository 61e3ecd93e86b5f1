"""The corpus pipeline: clean, deduplicate, mix and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns of ``documents``, with ``n_chars`` of the text as it
then is. SQL can't express the classifier, so there is no SQL for the whole; tests hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baleprice.llm import jaccard, mixing, pack, substrings, toxicity
from baleprice.llm.common import written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.3; it learns from the labels of those that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(toxicity.learning_rows(docs, labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 75 % of their 5-word shingles, the one with the least id."""
    return jaccard.one_per_component(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 13 words that start in a document with a smaller id too."""
    return _counted(substrings.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at weights 5, 2, 1: a row for each epoch that takes the document."""
    return _counted(mixing.mixed_documents(docs))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed best-fit into sequences: a row per piece."""
    return pack.pack(docs)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("substring_dedup", cut_repeats),
          ("mix", mix_sources), ("pack", pack_documents)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
