"""The corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it again as the next one's docs. A stage's own tables and its predecessor's output are deleted once it is written.

Rows are judged as rows: a repeated or null doc_id takes no other row with it. Null and empty texts are
scored, have no shingles, words or personal data, and are packed as their end id if they pass the quality stage. Of copies, and of ties
within a group, one row stays (ngram_join.one_of_each). Very long texts are worked on whole, an empty table gives no pieces, and columns
beyond those of documents are left out whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.llm import decontam, ngram_join, packing, pii, quality
from stratiform.llm.common import Scratch, bound_batches, own_scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose compression score reaches 0.7."""
    bound_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of the n-gram Jaccard join, that of the smallest doc_id."""
    bound_batches(spark)
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated rows."""
    bound_batches(spark)
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the text."""
    bound_batches(spark)
    masked = pii.mask_documents(docs, pii.train())
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_classifier), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]

#: SQL can't express the compression classifier; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with own_scratch(spark):  # a stage's operators write their tables here
            before, docs = docs, scratch.put(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(before)
    return docs
