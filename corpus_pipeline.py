"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

Quality classifier (what it rejects goes), n-gram Jaccard join (one document of each group stays), personal data
(masked), mixing of sources to target weights (rows dropped or repeated), best-fit packing (pieces of sequences). All
but the last return the columns of documents. The classifier reads ``labels`` beside the documents it is given.

Null and empty texts, equal ids, repeated rows and extra columns of any name go through as each operator's docstring
says: the classifier scores an empty text like any other, the join keeps rows without words or id, and of equal rows one;
the mix keeps a source without tokens once; an empty table gives an empty result. An id that two texts share stays with
each row.

SQL can express neither the classifier, the conditional random field nor the tokenizer, so there is no ORACLE_SQL;
tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetspark.llm import jaccard, mixing, packing, pii, quality
from sheetspark.llm.storage import discard, keep


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach grade 1 with probability 0.5 or more."""
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id."""
    return jaccard.survivors(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences. A document that the mix repeats has its pieces as
    often."""
    return packing.pack(keep(packing.cut(docs), "pieces")).drop("rid")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("personal data", personal_data),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, keep(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return docs
