"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """Folder below `spark.checkpoint.dir`; a temporary one only where it is unset in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/pharmasift-{app}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folders[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: computed once, whoever reads them or is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
