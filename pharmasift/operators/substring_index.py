"""Substring search over signal names by trigram postings.

    keys       drug_key, pt: every pair once
    postings   gram, drug_key, pt        by hash bucket of the gram

A search of three or more characters reads the postings of its own trigrams only, keeps pairs that have
all of them, and verifies these by the search itself; a shorter one scans the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmasift.functions.text import contains_ci

KEY = ("drug_key", "pt")
SIZE = 3
BUCKETS = 64


def grams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text; none if it is shorter or null."""
    low = F.lower(text)
    n = F.char_length(low) - (SIZE - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(low, i, SIZE))))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def store(signals: DataFrame, path: str, mode: str = "error") -> None:
    """Index the pairs of a table; with mode `append` those of a further one."""
    pairs = signals.select(*KEY).distinct()
    pairs.write.mode(mode).parquet(f"{path}/keys")
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(*(F.coalesce(grams(F.col(c)), none) for c in KEY)))
    each = pairs.select(F.explode(both).alias("gram"), *KEY).withColumn("bucket", bucket(F.col("gram")))
    (
        each.repartition("bucket", F.pmod(F.xxhash64(*KEY), F.lit(4))).sortWithinPartitions("bucket", "gram")
        .write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    )


def candidates(spark: SparkSession, path: str, search: str) -> DataFrame:
    """Pairs with all trigrams of the search, or all pairs if it has none."""
    asked = spark.range(1).select(grams(F.lit(search)).alias("g"), F.transform(grams(F.lit(search)), bucket).alias("b")).first()
    if not asked["g"]:
        return spark.read.parquet(f"{path}/keys").distinct()
    postings = spark.read.schema("gram string, drug_key string, pt string, bucket int").parquet(f"{path}/postings")
    own = postings.where(F.col("bucket").isin(sorted(set(asked["b"]))) & F.col("gram").isin(asked["g"]))
    return own.groupBy(*KEY).agg(F.countDistinct("gram").alias("_n")).where(F.col("_n") == len(asked["g"])).select(*KEY)


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Pairs whose drug or reaction contains the text, without regard to case, literally."""
    return candidates(spark, path, text).where(contains_ci(F.col("drug_key"), text) | contains_ci(F.col("pt"), text))
