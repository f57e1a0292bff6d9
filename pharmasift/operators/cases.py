"""Case level: newest version per case and one row of facts per report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.operators.joins import dealt

# Outcome code of each 0/1 flag.
OUTCOME_CODES = {"death_flag": "DE", "hosp_flag": "HO", "lt_flag": "LT"}


def best_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the highest `order` values (nulls lowest).

    Remaining columns break ties, so the survivor does not depend on partitioning.
    An aggregate instead of a ranking window: each task first reduces its own rows,
    which keeps a key that holds a large share of all rows off a single task.
    """
    payload = order + [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*payload)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def latest_version(demo: DataFrame) -> DataFrame:
    """Highest case version per case; ties go to the highest report id."""
    return best_row(demo, ["caseid"], ["caseversion", "primaryid"])


def outcome_flags(outc: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """0/1 flag columns per report, combined with a logical OR."""
    code = F.upper("outc_cod")
    return outc.groupBy("primaryid").agg(
        *[
            F.max(F.when(code == value, 1).otherwise(0)).alias(name)
            for name, value in (codes or OUTCOME_CODES).items()
        ]
    )


def dealt_facts(latest: DataFrame, outc: DataFrame, tasks: int) -> DataFrame:
    """`case_facts` dealt by report; outcomes without a flag are left out before, as reports without outcomes have zero flags."""
    serious = outc.filter(F.upper("outc_cod").isin(list(OUTCOME_CODES.values()))).select("primaryid", "outc_cod")
    rows = latest.select("primaryid", "caseid", "fda_dt", "source_quarter")
    return case_facts(dealt(rows, tasks), outcome_flags(dealt(serious, tasks)))


def case_facts(latest: DataFrame, flags: DataFrame) -> DataFrame:
    """Report-level attributes for the pair join, unique on primaryid.

    Reports without an outcome row keep zero flags.
    """
    names = [c for c in flags.columns if c != "primaryid"]
    unique = latest.groupBy("primaryid").agg(
        F.min(F.struct("caseid", "fda_dt", "source_quarter")).alias("c")
    )
    joined = unique.join(flags, "primaryid", "left")
    return joined.select(
        "primaryid",
        "c.caseid",
        F.try_to_date("c.fda_dt", "yyyyMMdd").alias("fda_dt"),
        "c.source_quarter",
        *[F.coalesce(F.col(n), F.lit(0)).cast("int").alias(n) for n in names],
    )
