"""Documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept and returns the columns of documents; the last
one returns packed pieces. Stages are written as Parquet in the shared folder in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmasift.llm import contamination, exact_dedup, near_dedup, packing, quality
from pharmasift.llm.common import stored, without


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject; it learns from the documents and the labels table."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, name="_reject_score")
    return scored.where(F.col("_reject_score") < quality.REJECT).drop("_reject_score")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, white space aside."""
    return exact_dedup.drop_duplicates(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a stored row number `_row`: ids may be null or repeated, and each row is decided by itself."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 80 % of their five-word shingles.

    The smallest id stays, a null id comes last; of rows that share it, the first.
    """
    rows = numbered(docs)
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("key"), "text")
    marks = near_dedup.near_duplicates(keyed, id="key")
    return without(rows, stored(marks.where(~F.col("kept")).select("key._row"), "dropped"), "_row").drop("_row")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    rows = numbered(docs)
    found = contamination.contained(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id="_row")
    return without(rows, stored(found.select("_row"), "contaminated"), "_row").drop("_row")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: Tokenizing and trained models are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
