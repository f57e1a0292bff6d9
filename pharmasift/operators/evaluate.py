"""Detection quality against a golden table (drug_key, pt, comm_date, comm_label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.functions import scores
from pharmasift.functions.rounding import half_even
from pharmasift.operators.joins import distinct_keys, with_scalars
from pharmasift.operators.review import meets

KEY = ["drug_key", "pt"]


def upper_median(column: str):
    """Element n // 2 of the ascending values, as an aggregate.

    The discrete median over descending order takes the upper of two middle values.
    It keeps value counts, not rows, so its state is bounded by the distinct values.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def first_seen(pairs: DataFrame) -> DataFrame:
    """Earliest report date per pair."""
    return pairs.groupBy(*KEY).agg(F.min("fda_dt").alias("first_flagged_date"))


def lead_times(
    golden: DataFrame, pairs: DataFrame, signals: DataFrame, min_prr: float, min_cases: int
) -> DataFrame:
    """Days from the first report to the notice, and whether the pair is flagged."""
    seen = first_seen(pairs.join(distinct_keys(golden, KEY), KEY, "left_semi"))
    flagged = distinct_keys(meets(signals, min_prr, min_cases), KEY).withColumn(
        "_flagged", F.lit(True)
    )
    days = F.datediff("comm_date", "first_flagged_date")
    return (
        golden.join(seen, KEY, "left")
        .join(flagged, KEY, "left")
        .select(
            *KEY, "comm_date", "comm_label", "first_flagged_date",
            days.alias("lead_time_days"),
            F.coalesce("_flagged", F.lit(False)).alias("flagged"),
        )
    )


def with_lead_class(leads: DataFrame) -> DataFrame:
    return leads.withColumn(
        "lead_class", scores.lead_class(F.col("lead_time_days"), F.col("flagged"))
    )


def lead_summary(leads: DataFrame) -> DataFrame:
    """One row: upper median, early detections, golden pairs, flagged pairs."""
    return leads.agg(
        upper_median("lead_time_days").cast("int").alias("median_lead_time"),
        F.count_if(F.col("lead_time_days") > 0).alias("positive_detections"),
        F.count(F.lit(1)).alias("total_golden"),
        F.count_if("flagged").alias("flagged_count"),
    )


def golden_breakdown(
    golden: DataFrame, signals: DataFrame, min_prr: float, min_cases: int
) -> DataFrame:
    """Every golden pair with its signal's numbers, null where not flagged."""
    hit = meets(signals, min_prr, min_cases).select(
        *KEY, "prr", "drug_reaction_count", "stat_score", F.lit(True).alias("_hit")
    )
    return golden.join(hit, KEY, "left").select(
        *KEY, "comm_date", "comm_label", F.coalesce("_hit", F.lit(False)).alias("flagged"),
        "prr", "drug_reaction_count", "stat_score",
    )


def precision(breakdown: DataFrame) -> DataFrame:
    """One row: hits among the golden pairs, over those that have a notice date.

    `precision` keeps the published name; the figure is a recall over the golden
    set, so it is repeated as `golden_recall`.
    """
    dated = F.count_if(F.col("comm_date").isNotNull())
    hits = F.count_if("flagged")
    share = half_even(F.try_divide(hits, dated), 3)
    return breakdown.agg(
        dated.alias("total_golden"),
        hits.alias("flagged"),
        (dated - hits).alias("not_flagged"),
        share.alias("precision"),
        share.alias("golden_recall"),
    )


def summary(leads: DataFrame) -> DataFrame:
    """One row of headline figures; only dated pairs count for the precision."""
    dated = F.count_if(F.col("comm_date").isNotNull())
    hits = F.count_if(F.col("flagged") & F.col("comm_date").isNotNull())
    return with_scalars(
        leads.agg(
            F.count(F.lit(1)).alias("total_golden"),
            hits.alias("flagged"),
            (dated - hits).alias("not_flagged"),
            half_even(F.try_divide(hits, dated), 3).alias("precision"),
            dated.alias("precision_denominator"),
        ),
        lead_summary(leads).select("median_lead_time", "positive_detections"),
    )
