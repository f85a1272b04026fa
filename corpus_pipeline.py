"""The corpus pipeline: documents without toxic text, near copies and secrets, mixed by source and packed into sequences."""

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, secrets, simhash, toxicity
from tidemark.llm.common import settle, table
from tidemark.llm.queries import tokenizer_files
from tidemark.sources.storage import drop_scratch, scratch_path, scratch_scope

#: The stages train models and hash words; their results are tested against brute-force versions.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain does not find toxic."""
    settle(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash fingerprints (three words) linked at 3 bits or fewer, that of the smallest doc_id."""
    settle(spark)
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    settle(spark)
    return secrets.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    settle(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences."""
    settle(spark)
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("toxicity", without_toxic), ("near_dedup", without_copies), ("secret_scan", without_secrets), ("source_mix", mixed),
    ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared scratch folder and read by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):  # what a stage wrote on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop_scratch(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
