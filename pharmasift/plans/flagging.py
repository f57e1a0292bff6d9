"""From pairs, or straight from the report entities, to flagged signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.operators import disproportionality as dp
from pharmasift.operators import temporal
from pharmasift.operators.cases import dealt_facts, latest_version
from pharmasift.operators.joins import task_count
from pharmasift.operators.pairs import combine, dealt_drugs, dealt_reactions, report_shards


def flag(
    pairs: DataFrame,
    limits: dp.Thresholds,
    junk: DataFrame | Sequence[str] = dp.JUNK_TERMS,
    spike_max: float | None = temporal.SPIKE_MAX_SHARE,
    late_periods: Sequence[str] = temporal.LATE_PERIODS,
    late_max: float | None = temporal.LATE_MAX_SHARE,
    unique: bool = True,
    marked: bool = False,
) -> DataFrame:
    """Flagged signals of a stored pairs table.

    Of unique pairs, counts and period shares come from the same pass, and the period rules
    are a filter of the candidates. Of `marked` ones, which are unique, the marginals are sums and need no distinct.
    """
    if unique:
        marginals = dp.marked_totals(pairs) if marked else (dp.drug_totals(pairs), dp.reaction_totals(pairs), dp.report_total(pairs))
        table = dp.ratio_table(temporal.cells_with_shares(pairs, late_periods), *marginals)
        kept = temporal.keep_even(dp.threshold(table, limits, junk), pairs, spike_max, late_periods, late_max)
        return dp.signal_table(kept)
    cells = dp.threshold(dp.contingency(pairs, unique), limits, junk)
    kept = temporal.filter_periods(cells, pairs, spike_max, late_periods, late_max)
    return dp.signal_table(kept)


def flag_reports(
    demo: DataFrame,
    drug: DataFrame,
    reac: DataFrame,
    outc: DataFrame,
    name_map: DataFrame,
    limits: dp.Thresholds,
    junk: DataFrame | Sequence[str] = dp.JUNK_TERMS,
    roles: Sequence[str] = ("PS",),
    spike_max: float | None = temporal.SPIKE_MAX_SHARE,
    late_periods: Sequence[str] = temporal.LATE_PERIODS,
    late_max: float | None = temporal.LATE_MAX_SHARE,
) -> DataFrame:
    """Flagged signals in one plan, without storing the pairs; the same as those of `flag`.

    The marginal totals do not need the drug x reaction product: a report counts
    towards a drug when it is current and has a reaction, and towards a reaction when
    it is current and has a suspect drug. So the totals are plain counts over the
    de-duplicated inputs, and only the cell counts look at the product, which is
    reduced inside each task before it is shuffled.
    """
    tasks = task_count(demo, drug, reac, outc)
    facts = dealt_facts(latest_version(demo), outc, tasks)
    drugs = dealt_drugs(drug, name_map, roles, tasks)
    reactions = dealt_reactions(reac, tasks)
    valid = facts.join(drugs.select("primaryid"), "primaryid", "left_semi").join(
        reactions.select("primaryid"), "primaryid", "left_semi"
    )
    current_drugs = drugs.join(valid.select("primaryid"), "primaryid", "left_semi")
    current_reactions = reactions.join(valid.select("primaryid"), "primaryid", "left_semi")
    by_drug = current_drugs.groupBy("drug_key").agg(F.count(F.lit(1)).alias("drug_total"))
    by_reaction = current_reactions.groupBy("pt").agg(F.count(F.lit(1)).alias("reaction_total"))
    total = valid.agg(F.count(F.lit(1)).alias("n_total"))
    pairs = combine(facts, drugs, reactions, report_shards(drug, roles, tasks=tasks))
    table = dp.ratio_table(temporal.cells_with_shares(pairs, late_periods), by_drug, by_reaction, total)
    # every valid report has a pair, so its periods are those of the pairs
    return dp.signal_table(temporal.keep_even(dp.threshold(table, limits, junk), valid, spike_max, late_periods, late_max))


def flag_partials(
    partials: DataFrame,
    limits: dp.Thresholds,
    junk: DataFrame | Sequence[str] = dp.JUNK_TERMS,
    spike_max: float | None = temporal.SPIKE_MAX_SHARE,
    late_periods: Sequence[str] = temporal.LATE_PERIODS,
    late_max: float | None = temporal.LATE_MAX_SHARE,
) -> DataFrame:
    """Flagged signals of stored partial cells: no pair is read."""
    passing = dp.threshold(dp.contingency_of(partials), limits, junk)
    shares = temporal.shares_of(partials, late_periods)
    judged = passing.join(shares, ["drug_key", "pt"])
    periods = partials.groupBy("source_quarter").agg(F.sum("n_rows").alias("_rows")).filter("_rows > 0")
    return dp.signal_table(temporal.keep_even(judged, periods, spike_max, late_periods, late_max))
