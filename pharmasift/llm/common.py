"""Shared work folder, stored intermediate tables and small plan helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to this many rows of a few numbers (counted, not estimated) may be broadcast.
BROADCAST_ROWS = 500_000

_local_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors share.

    Where it is unset, a temporary folder serves a local session; a cluster gets an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/llm-{app}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_folders:
        _local_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folders[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage: later stages, and tasks repeated after an executor is lost, read
    the same rows. Values that depend on row order or partition (row ids) are fixed
    by this.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table of numbers is small enough, by its counted rows, to broadcast."""
    return df.count() <= rows


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row.

    Catalyst merges projections, and a lambda evaluates what it mentions for every element; a
    lambda's own variable is a value already.
    """
    return F.transform(F.array(value), body)[0]


def without(docs: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """The rows whose id is not among the stored ids; a null id is a value like any other.

    Up to BROADCAST_ROWS ids (counted) go to the rows, so that texts stay where they are.
    """
    out = ids.select(F.col(id).alias("_out")).distinct()
    out = F.broadcast(out) if small(ids) else out
    return docs.join(out, docs[id].eqNullSafe(out["_out"]), "left_anti")
