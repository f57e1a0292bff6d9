"""Unique (report, drug, reaction) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pharmasift.operators import naming
from pharmasift.operators.cases import dealt_facts, latest_version
from pharmasift.operators.joins import dealt, task_count

PAIR_COLUMNS = (
    "primaryid", "caseid", "drug_key", "rxcui", "pt", "fda_dt",
    "death_flag", "hosp_flag", "lt_flag", "source_quarter",
)
#: 0/1 columns: the one row of its report that counts for its drug, its reaction, and the total.
MARKS = ("for_drug", "for_reaction", "for_all")


def named_reactions(reac: DataFrame) -> DataFrame:
    """Lower-cased reactions of known reports, repeated ones too."""
    return reac.select("primaryid", F.lower(F.trim("pt")).alias("pt")).filter(
        F.col("primaryid").isNotNull() & F.col("pt").isNotNull() & (F.col("pt") != "")
    )


def dedup_reactions(reac: DataFrame) -> DataFrame:
    """One row per (report, lower-cased reaction)."""
    return named_reactions(reac).distinct()


def dealt_reactions(reac: DataFrame, tasks: int) -> DataFrame:
    """`dedup_reactions` dealt by report; `_first_pt` marks the report's smallest one. One sort does both and serves the next join."""
    before = F.lag("pt").over(Window.partitionBy("primaryid").orderBy("pt"))
    rows = dealt(named_reactions(reac), tasks).withColumn("_before", before)
    fresh = rows.filter(F.col("_before").isNull() | (F.col("_before") != F.col("pt")))
    return fresh.select("primaryid", "pt", F.col("_before").isNull().alias("_first_pt"))


def dealt_drugs(drug: DataFrame, name_map: DataFrame, roles: Sequence[str], tasks: int) -> DataFrame:
    """`naming.normalize` dealt by report; `_first_drug` marks the report's smallest one."""
    place = F.row_number().over(Window.partitionBy("primaryid").orderBy("drug_key"))
    return naming.normalize(drug, name_map, roles, tasks).withColumn("_first_drug", place == 1)


def report_shards(
    drug: DataFrame, roles: Sequence[str] = ("PS",), wide_report: int = 2048, tasks: int = 1
) -> DataFrame:
    """How many shards the suspect drugs of each wide report are spread over; other reports have no row.

    Raw rows are counted, an upper bound of the distinct drugs, so the count needs
    neither the name map nor the de-duplication and combines before its shuffle.
    """
    counted = naming.suspect_rows(drug, roles).groupBy("primaryid").agg(
        F.ceil(F.count(F.lit(1)) / wide_report).cast("int").alias("_shards")
    )
    return dealt(counted.filter("_shards > 1"), tasks)


def combine(
    cases: DataFrame, drugs: DataFrame, reactions: DataFrame, shards: DataFrame, marks: bool = False
) -> DataFrame:
    """All drug x reaction combinations of each current report.

    `cases` is unique on primaryid, `drugs` on (primaryid, drug_key) and `reactions`
    on (primaryid, pt), so the output is unique on its triple without another
    de-duplication. All four are dealt by report to as many tasks, so their joins need no shuffle. Superseded
    reports drop out against `cases` before the many-to-many step. A report with very many drugs has several shards: its
    drugs are spread over them and its reactions repeated once per shard, so that no single
    task has to produce the whole product; only such reports are shuffled again. With `marks` the output has MARKS as well
    (see `disproportionality.marked`): a drug meets the report's first reaction once, and a reaction its first drug.
    """
    columns = list(PAIR_COLUMNS)
    current = drugs.join(cases, "primaryid")
    if marks:
        first = {"for_drug": F.col("_first_pt"), "for_reaction": F.col("_first_drug"), "for_all": F.col("_first_pt") & F.col("_first_drug")}
        columns += [mark.cast("long").alias(name) for name, mark in first.items()]
    narrow = current.join(shards, "primaryid", "left").filter(F.col("_shards").isNull()).join(reactions, "primaryid")
    left = current.join(shards, "primaryid").withColumn("_shard", F.pmod(F.xxhash64("drug_key"), F.col("_shards")).cast("int"))
    right = reactions.join(shards, "primaryid").withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
    wide = left.drop("_shards").join(right.drop("_shards"), ["primaryid", "_shard"])
    return narrow.select(*columns).unionByName(wide.select(*columns))


def build_newest(
    newest: DataFrame,
    drug: DataFrame,
    reac: DataFrame,
    outc: DataFrame,
    name_map: DataFrame,
    roles: Sequence[str] = ("PS",),
    wide_report: int = 2048,
    marks: bool = False,
) -> DataFrame:
    """Unique drug-reaction pairs of the newest case versions, with each entity shuffled once on the report."""
    tasks = task_count(newest, drug, reac, outc)
    return combine(
        dealt_facts(newest, outc, tasks),
        dealt_drugs(drug, name_map, roles, tasks),
        dealt_reactions(reac, tasks),
        report_shards(drug, roles, wide_report, tasks),
        marks,
    )


def build(
    demo: DataFrame,
    drug: DataFrame,
    reac: DataFrame,
    outc: DataFrame,
    name_map: DataFrame,
    roles: Sequence[str] = ("PS",),
    wide_report: int = 2048,
    marks: bool = False,
) -> DataFrame:
    """From the four parsed report entities to unique drug-reaction pairs."""
    return build_newest(latest_version(demo), drug, reac, outc, name_map, roles, wide_report, marks)
