"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of ``documents`` (the last one
returns token ids). Stages work on all that their predecessor kept, and their decisions take effect:

1. quality: documents that importance resampling rejects go.
2. near_duplicates: of each component of documents with a shingle similarity of 0.75 or more the least id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: spans that look like secrets are replaced by ``<kind>``; ``n_chars`` follows.
5. bpe: texts become token ids.

Null texts pass the stages that judge texts as empty ones, null ids are never duplicates, and rows that repeat an id with
the same component stay together. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import bpe, decontamination, importance, ngram_join, secrets
from cinelake.llm.queries import vocabulary_path
from cinelake.session import saved

#: Not expressible in SQL: the sample depends on fitted models, the ids on a vocabulary.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.similar(docs)
    extra = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(saved(extra, "near-duplicates"), "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    old = "n" + "_" * max(map(len, docs.columns))  # no name of theirs
    cut = F.coalesce(F.col(old) - F.length("text"), F.lit(0))
    found = secrets.redacted(docs.withColumn(old, F.length("text")))
    return found.withColumn("n_chars", (F.col("n_chars") - cut).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
