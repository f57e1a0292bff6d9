"""Literature corpus: documents from records, incremental additions, group sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmasift.operators.joins import attach, distinct_keys

# Documents that make a group usable, and that make loading stop.
SUFFICIENT = 50
FULL_GROUP = 200
SKIP_SHARE = 0.75


def doc_key(group: Column, pmid: Column) -> Column:
    return F.concat_ws("_", group, pmid)


def pmid_of(key: Column) -> Column:
    """Part after the first underscore."""
    return F.substring(key, F.instr(key, "_") + 1, F.length(key))


def compose(records: DataFrame) -> DataFrame:
    """Title plus joined abstract parts; records without abstract text are dropped."""
    abstract = F.concat_ws(" ", F.filter("abstract_parts", lambda p: p.isNotNull()))
    joined = records.withColumn("_abstract", abstract).filter(F.trim("_abstract") != "")
    return joined.withColumns(
        {
            "doc_key": doc_key(F.col("group_key"), F.col("pmid")),
            "text": F.concat_ws(" ", F.coalesce("title", F.lit("")), F.col("_abstract")),
        }
    ).drop("_abstract", "title", "abstract_parts")


def dedup_ids(found: DataFrame, position: str = "position") -> DataFrame:
    """First occurrence of each id inside its group; other groups may repeat the id."""
    return found.groupBy("group_key", "pmid").agg(F.min(position).alias(position))


def group_sizes(
    docs: DataFrame, sufficient: int = SUFFICIENT, full: int = FULL_GROUP
) -> DataFrame:
    """Documents per group, whether that is enough to search and enough to stop loading."""
    counted = docs.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.withColumns(
        {
            "sufficient": F.col("n_docs") >= sufficient,
            "skip_loading": F.col("n_docs") >= int(full * SKIP_SHARE),
        }
    )


def new_documents(
    records: DataFrame,
    loaded: DataFrame,
    full: int | None = None,
    embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Records to append: id not loaded in the group, text present.

    With `full` (a loading quota, published: FULL_GROUP) records of groups that hold
    SKIP_SHARE of it already are left out as well.
    `embed` may be any Column function of the text, a pandas UDF for instance.
    """
    open_records = records
    if full is not None:
        full_groups = group_sizes(loaded, full=full).filter("skip_loading").select(
            "group_key", F.lit(True).alias("_full")
        )
        open_records = attach(records, full_groups, ["group_key"]).filter(
            F.col("_full").isNull()
        ).drop("_full")
    fresh = open_records.join(
        distinct_keys(loaded, ["group_key", "pmid"]), ["group_key", "pmid"], "left_anti"
    )
    docs = compose(fresh).groupBy("group_key", "pmid").agg(
        F.min(F.struct("doc_key", "text", "year")).alias("d")
    ).select("group_key", "pmid", "d.*")
    return docs if embed is None else docs.withColumn("embedding", embed(F.col("text")))
