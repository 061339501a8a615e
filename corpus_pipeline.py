"""A corpus made ready for training, stage by stage; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabletools.llm.exact_dedup import drop_exact_copies
from tabletools.llm.mixing import mixed_documents
from tabletools.llm.packing import pack
from tabletools.llm.simhash import keep_one_of_each
from tabletools.llm.toxicity import drop_toxic
from tabletools.sources.staging import staging_path


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained score holds toxic (0.5 or more) go. Null and empty texts are scored like others and stay if their score says so;
    repeated rows get the same score; very long texts are scored whole; an empty table stays empty."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text (null counts as empty) the row with the largest doc_id stays, of repeated rows one."""
    return drop_exact_copies(docs)


def _simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest doc_id stays. Texts without words have one fingerprint, so one
    of them stays; a null doc_id is left only where no other is linked; rows that share a doc_id stay if one of them does."""
    return keep_one_of_each(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the schedule takes it, whole, in the order of its slots. Null and empty texts have no words and go, as do
    documents beyond their source's target; null sources are a source; repeated rows count as one document."""
    return mixed_documents(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; a null or empty text is its end token alone, a document that the mix repeats is packed each time."""
    return pack(docs)


STAGES = [("toxicity", _toxicity), ("exact dedup", _exact_dedup), ("simhash near-dedup", _simhash_near_dedup),
          ("mixing", _mixing), ("packing", _packing)]

ORACLE_SQL = None      # SQL can express neither the trained filter nor the linked groups


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = staging_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
