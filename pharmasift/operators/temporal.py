"""Quality filters on how a pair's reports spread over reporting periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.operators.joins import with_scalars

# Default limits and late periods.
SPIKE_MAX_SHARE = 0.70
LATE_MAX_SHARE = 0.85
LATE_PERIODS = ("2023Q3", "2023Q4")


def period_counts(pairs: DataFrame) -> DataFrame:
    """Rows per (drug, reaction, period); combines before the shuffle."""
    return pairs.groupBy("drug_key", "pt", "source_quarter").agg(
        F.count(F.lit(1)).alias("period_rows")
    )


def period_shares(pairs: DataFrame, late_periods: Sequence[str] = LATE_PERIODS) -> DataFrame:
    """Largest-period share and late-period share per (drug, reaction), from one scan."""
    is_late = F.coalesce(F.col("source_quarter").isin(list(late_periods)), F.lit(False))
    per_pair = period_counts(pairs).groupBy("drug_key", "pt").agg(
        F.max("period_rows").alias("max_rows"),
        F.sum("period_rows").alias("total_rows"),
        F.coalesce(F.sum(F.when(is_late, F.col("period_rows"))), F.lit(0)).alias("late_rows"),
    )
    return per_pair.withColumns(
        {
            "spike_share": F.col("max_rows") / F.col("total_rows"),
            "late_share": F.col("late_rows") / F.col("total_rows"),
        }
    )


def shares_of(partials: DataFrame, late_periods: Sequence[str] = LATE_PERIODS) -> DataFrame:
    """Period shares of stored partial cells (see `disproportionality.partial_cells`)."""
    is_late = F.coalesce(F.col("source_quarter").isin(list(late_periods)), F.lit(False))
    per_period = partials.groupBy("drug_key", "pt", "source_quarter").agg(F.sum("n_rows").alias("_rows")).filter("_rows > 0")
    return per_period.groupBy("drug_key", "pt").agg(
        (F.max("_rows") / F.sum("_rows")).alias("spike_share"),
        (F.coalesce(F.sum(F.when(is_late, F.col("_rows"))), F.lit(0)) / F.sum("_rows")).alias("late_share"),
    )


def filter_periods(
    signals: DataFrame,
    pairs: DataFrame,
    spike_max: float | None = SPIKE_MAX_SHARE,
    late_periods: Sequence[str] = LATE_PERIODS,
    late_max: float | None = LATE_MAX_SHARE,
) -> DataFrame:
    """Keep signals that are neither a one-period spike nor a late surge.

    See `keep_even` for the rules. Only the rows of the signals' pairs are counted.
    """
    own = pairs.join(signals.select("drug_key", "pt").distinct(), ["drug_key", "pt"], "left_semi")
    kept = keep_even(period_shares(own, late_periods), pairs, spike_max, late_periods, late_max)
    return signals.join(kept.select("drug_key", "pt"), ["drug_key", "pt"], "left_semi")


def scope(pairs: DataFrame, late_periods: Sequence[str] = LATE_PERIODS) -> DataFrame:
    """One row: how many periods the data has, and whether one of them is late. Reads the period only."""
    periods = pairs.groupBy("source_quarter").agg(F.count(F.lit(1)).alias("_n"))
    is_late = F.coalesce(F.col("source_quarter").isin(list(late_periods)), F.lit(False))
    return periods.agg(
        F.count(F.lit(1)).alias("n_periods"), F.coalesce(F.max(is_late), F.lit(False)).alias("any_late")
    )


def keep_even(
    shares: DataFrame,
    pairs: DataFrame,
    spike_max: float | None = SPIKE_MAX_SHARE,
    late_periods: Sequence[str] = LATE_PERIODS,
    late_max: float | None = LATE_MAX_SHARE,
) -> DataFrame:
    """Rows with spike_share and late_share that pass the period rules.

    The spike rule does not apply to data of a single period and the surge rule not
    to data without late periods. `None` switches a rule off.
    """
    judged = with_scalars(shares, scope(pairs, late_periods))
    keep = F.lit(True)
    if spike_max is not None:
        keep = keep & ((F.col("n_periods") <= 1) | (F.col("spike_share") <= spike_max))
    if late_max is not None:
        keep = keep & (~F.col("any_late") | (F.col("late_share") <= late_max))
    return judged.filter(keep).select(*shares.columns)


def cells_with_shares(pairs: DataFrame, late_periods: Sequence[str] = LATE_PERIODS) -> DataFrame:
    """Cell counts and period shares of unique pairs, from one scan and one shuffle of partial counts."""
    is_late = F.coalesce(F.col("source_quarter").isin(list(late_periods)), F.lit(False))
    flags = {"death_count": "death_flag", "hosp_count": "hosp_flag", "lt_count": "lt_flag"}
    by_period = pairs.groupBy("drug_key", "pt", "source_quarter").agg(
        F.count("primaryid").alias("a"), F.count(F.lit(1)).alias("_rows"),
        *(F.sum(flag).alias(name) for name, flag in flags.items()),
    )
    cells = by_period.groupBy("drug_key", "pt").agg(
        F.sum("a").alias("a"), *(F.sum(name).alias(name) for name in flags),
        F.max("_rows").alias("_max"), F.sum("_rows").alias("_all"),
        F.coalesce(F.sum(F.when(is_late, F.col("_rows"))), F.lit(0)).alias("_late"),
    )
    return cells.select(
        "drug_key", "pt", "a", *flags,
        (F.col("_max") / F.col("_all")).alias("spike_share"), (F.col("_late") / F.col("_all")).alias("late_share"),
    )
