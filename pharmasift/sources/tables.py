"""Appending, upserting and replacing stored tables without a transactional format."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmasift.operators.cases import best_row
from pharmasift.operators.joins import distinct_keys
from pharmasift.operators.storage import stored
from pharmasift.operators.quality import decision_rules, split_valid

PAIR_KEY = ("primaryid", "drug_key", "pt")
SIGNAL_KEY = ("drug_key", "pt")


def new_rows(incoming: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key."""
    keys = list(key)
    unique = best_row(incoming, keys, [])
    return unique.join(distinct_keys(existing, keys), keys, "left_anti").select(*incoming.columns)


#: Buckets of a key-bucketed table; fixed for its life.
BUCKETS = 32
BUCKET = "_bucket"


def bucketed(df: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """With the hash bucket of the key, the partition column of a key-bucketed table."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def touched(df: DataFrame) -> list[int]:
    """The buckets that occur; at most as many numbers as there are buckets."""
    return [r[0] for r in df.select(BUCKET).distinct().collect()]


def append_new(
    incoming: DataFrame, path: str, key: Sequence[str] = PAIR_KEY, partition: str | None = None, buckets: int | None = None
) -> None:
    """Append what is new, one row per key; running it again adds nothing.

    With `buckets` the table is partitioned by a hash of the key, and only the keys of buckets that incoming
    rows fall into are read and compared.
    """
    spark = incoming.sparkSession
    rows = best_row(incoming, list(key), [])
    parts = [partition] if partition else []
    if buckets:
        rows, parts = stored(bucketed(rows, key, buckets), "incoming"), [*parts, BUCKET]
    if path_exists(spark, path):
        existing = spark.read.parquet(path)
        if buckets:
            existing = existing.where(F.col(BUCKET).isin(touched(rows)))
        rows = rows.join(distinct_keys(existing, list(key)), list(key), "left_anti").select(*rows.columns)
    rows.write.mode("append").partitionBy(*parts).parquet(path)


def upsert(
    target: DataFrame, source: DataFrame, key: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Target with the source rows replacing those of the same key or added to them.

    Source rows that share a key are first reduced to the one highest in `order`.
    """
    keys = list(key)
    latest = best_row(source, keys, list(order))
    kept = target.join(latest.select(*keys), keys, "left_anti")
    return kept.select(*target.columns).unionByName(latest, allowMissingColumns=True)


#: Preset: length of a name in the published table.
PUBLISHED_NAME_CHARS = 1000


def clip_names(name_map: DataFrame, length: int | None = None) -> DataFrame:
    """Name-map rows with names cut to the stored length, if there is one."""
    if length is None:
        return name_map
    return name_map.withColumns(
        {c: F.substring(c, 1, length) for c in ("prod_ai", "canonical_name")}
    )


def split_decisions(
    decisions: DataFrame, allowed: Sequence[str] = ("APPROVE", "REJECT")
) -> tuple[DataFrame, DataFrame]:
    """Upper-cased valid decisions to append, and the rejected rows with reasons."""
    good, bad = split_valid(decisions, decision_rules(allowed))
    return good.withColumn("decision", F.upper("decision")), bad


def null_nan(df: DataFrame) -> DataFrame:
    """NaN in floating columns and blank text become null."""
    cleaned = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            cleaned[name] = F.when(~F.isnan(name), F.col(name))
        elif kind == "string":
            cleaned[name] = F.when(F.trim(name) != "", F.col(name))
    return df.withColumns(cleaned) if cleaned else df


# --- replacing and key-bucketed tables ---------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def has_buckets(spark: SparkSession, path: str) -> bool:
    """Whether a key-bucketed table has rows: one without any is an empty folder."""
    folders = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}=*")
    return bool(folders.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folders))


def replace(df: DataFrame, root: str, partition: str | None = None) -> DataFrame:
    """Write the rows as a new complete table below `root` and return it for readers.

    What was read to compute them, an earlier table of `root` for instance, is not touched, and a failed job
    leaves it in place.
    """
    path = f"{root}/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_into(source: DataFrame, path: str, key: Sequence[str], order: Sequence[str] = (), buckets: int = BUCKETS) -> list[int]:
    """Upsert into a table partitioned by hash bucket of the key, creating it when needed; the buckets rewritten.

    Only buckets that source rows fall into are read and overwritten; the files of all others stay. The
    new content of these buckets is stored before the overwrite, and upserting the same rows again gives the same table.
    An empty source changes nothing. The bucket is the last column of the table.
    """
    spark = source.sparkSession
    latest = stored(bucketed(best_row(source, list(key), list(order)), key, buckets), "upserts")
    numbers = touched(latest)
    if not numbers and path_exists(spark, path):
        return []
    merged = latest
    if has_buckets(spark, path):
        current = spark.read.parquet(path)
        current = current.where(F.col(BUCKET).isin(numbers))
        merged = stored(upsert(current, latest, [*key, BUCKET], order), "merged")
    (
        merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    )
    return sorted(numbers)


# --- exports and JDBC ------------------------------------------------------


def export_corpus(docs: DataFrame, path: str) -> None:
    """Corpus as JSON lines in group and id order."""
    docs.orderBy("group_key", "pmid").write.mode("error").json(path)


def corpus_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_docs")).orderBy("group_key")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split: tuple[str, int, int, int] | None = None,
    **options: str,
) -> DataFrame:
    """Table over JDBC; `split` = (column, lower, upper, partitions) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if split:
        column, lower, upper, n = split
        reader = reader.options(
            partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=n
        )
    return reader.options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def copy_table(spark: SparkSession, url: str, source: str, target: str, **options: str) -> None:
    """Copy a JDBC table, missing markers turned into nulls on the way."""
    write_jdbc(null_nan(read_jdbc(spark, url, source, **options)), url, target, "overwrite", **options)
