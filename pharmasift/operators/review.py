"""Review feed, queue, decision history and the counters shown with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.functions import scores
from pharmasift.functions.rounding import half_even
from pharmasift.functions.text import contains_ci, json_array_or_empty
from pharmasift.operators.cases import best_row
from pharmasift.operators.joins import distinct_keys, with_scalars

KEY = ["drug_key", "pt"]
# Price per million tokens.
INPUT_PRICE, OUTPUT_PRICE = 0.15, 0.60


def latest_decision(decisions: DataFrame) -> DataFrame:
    """Newest decision per pair."""
    newest = best_row(decisions.select(*KEY, "decided_at", "decision"), KEY, ["decided_at"])
    return newest.select(*KEY, "decision")


def feed_rows(signals: DataFrame, briefs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every signal with its brief's scores and its newest decision."""
    brief = briefs.select(*KEY, "lit_score", "priority", "generation_error")
    decided = latest_decision(decisions).withColumnRenamed("decision", "hitl_decision")
    return signals.join(brief, KEY, "left").join(decided, KEY, "left")


def filter_feed(
    feed: DataFrame, priority: str | None = None, search: str | None = None
) -> DataFrame:
    """Optional tier filter and literal, case-insensitive search in drug or reaction."""
    if priority:
        feed = feed.filter(F.col("priority") == priority)
    if search:
        feed = feed.filter(
            contains_ci(F.col("drug_key"), search) | contains_ci(F.col("pt"), search)
        )
    return feed


FEED_ORDERS = {
    "feed": lambda: [scores.tier_rank(F.col("priority")), F.desc("prr")],
    "priority": lambda: [scores.tier_rank(F.upper(F.coalesce("priority", F.lit("P4"))), 4)],
    "prr": lambda: [F.desc(F.coalesce("prr", F.lit(0.0)))],
    "cases": lambda: [F.desc(F.coalesce("drug_reaction_count", F.lit(0)))],
    "deaths": lambda: [F.desc(F.coalesce("death_count", F.lit(0)))],
}


def order_feed(feed: DataFrame, by: str = "feed") -> DataFrame:
    """Order by one of FEED_ORDERS; drug and reaction settle ties."""
    return feed.orderBy(*FEED_ORDERS[by](), *KEY)


def feed_page(
    feed: DataFrame, limit: int = 200, offset: int = 0, by: str = "feed"
) -> DataFrame:
    """One page of the ordered feed."""
    return order_feed(feed, by).offset(offset).limit(limit)


def brief_detail(signals: DataFrame, briefs: DataFrame, drug_key: str, pt: str) -> DataFrame:
    """Full record of one pair; an empty result means the signal does not exist."""
    wanted = (F.col("drug_key") == drug_key) & (F.col("pt") == pt)
    joined = signals.filter(wanted).join(clean_briefs(briefs).drop("stat_score"), KEY, "left")
    return joined.limit(1)


def clean_briefs(briefs: DataFrame) -> DataFrame:
    """JSON array columns parsed, decimals as doubles."""
    for name, kind in briefs.dtypes:
        if name in ("key_findings", "pmids_cited", "search_queries") and kind == "string":
            briefs = briefs.withColumn(name, json_array_or_empty(F.col(name)))
        elif kind.startswith("decimal"):
            briefs = briefs.withColumn(name, F.col(name).cast("double"))
    return briefs


def in_list(signals: DataFrame, wanted: DataFrame) -> DataFrame:
    """Signals of the listed drugs or pairs; missing outcome counts become 0.

    Joins on the columns `wanted` shares with the key, so a one-column list selects
    drugs and a two-column list selects pairs.
    """
    keys = [c for c in KEY if c in wanted.columns]
    chosen = signals.join(distinct_keys(wanted, keys), keys, "left_semi")
    return chosen.fillna(0, ["death_count", "hosp_count", "lt_count"]).orderBy(F.desc("prr"), *KEY)


def meets(signals: DataFrame, min_prr: float, min_cases: int) -> DataFrame:
    return signals.filter(
        (F.col("prr") >= min_prr) & (F.col("drug_reaction_count") >= min_cases)
    )


def investigated(feed: DataFrame) -> DataFrame:
    """Signals with a tier, by tier then statistical score."""
    return feed.filter(F.col("priority").isNotNull()).orderBy(
        scores.tier_rank(F.upper("priority")),
        F.desc(F.coalesce("stat_score", F.lit(0.0))),
        *KEY,
    )


def uninvestigated(feed: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Signals without a tier, except the pending pairs, by ratio."""
    open_rows = feed.filter(F.col("priority").isNull())
    if pending is not None:
        open_rows = open_rows.join(distinct_keys(pending, KEY), KEY, "left_anti")
    return open_rows.orderBy(F.desc(F.coalesce("prr", F.lit(0.0))), *KEY)


def undecided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows whose pair has no decision yet."""
    return rows.join(distinct_keys(decisions, KEY), KEY, "left_anti")


def queue(signals: DataFrame, briefs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Error-free briefs that wait for a decision, in review order."""
    ready = briefs.filter(~F.col("generation_error"))
    context = signals.select(
        *KEY, "prr", F.col("drug_reaction_count").alias("case_count"),
        "death_count", "hosp_count", "lt_count",
    )
    waiting = undecided(ready, decisions).join(context, KEY)
    return waiting.select(
        "brief_id", *KEY, "priority", "stat_score", "lit_score", "recommended_action",
        "brief_text", "generation_error", "prr", "case_count", "death_count", "hosp_count",
        "lt_count", "generated_at",
    ).orderBy(scores.tier_rank(F.col("priority")), F.desc_nulls_last("stat_score"), *KEY)


def history(decisions: DataFrame) -> DataFrame:
    """All decisions, newest first."""
    return decisions.select(*KEY, "decision", "reviewer_note", "decided_at").orderBy(
        F.desc_nulls_last("decided_at"), *KEY, "decision"
    )


# --- counters --------------------------------------------------------------


def feed_counts(signals: DataFrame, briefs: DataFrame) -> DataFrame:
    """One row: signals overall, per tier and without a tier."""
    joined = signals.select(*KEY).join(briefs.select(*KEY, "priority"), KEY, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("priority") == t).alias(t.lower()) for t in scores.TIERS],
        F.count_if(F.col("priority").isNull()).alias("uninvestigated"),
    )


def pending_briefs(briefs: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: error-free briefs without a decision."""
    waiting = undecided(briefs.filter(~F.col("generation_error")), decisions)
    return waiting.agg(F.count(F.lit(1)).alias("pending_briefs"))


def signal_gauges(signals: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: flagged signals, and those of them without a decision."""
    flagged = signals.agg(F.count(F.lit(1)).alias("signals_flagged"))
    waiting = undecided(signals, decisions).agg(F.count(F.lit(1)).alias("pending_signals"))
    return with_scalars(flagged, waiting)


def pending_per_tier(waiting: DataFrame) -> DataFrame:
    tier = F.upper(F.coalesce("priority", F.lit("")))
    return waiting.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(tier == t).alias(t.lower()) for t in scores.TIERS],
    )


def table_counts(signals: DataFrame, briefs: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: flagged signals, error-free briefs, decisions."""
    n = F.count(F.lit(1))
    one = signals.agg(n.alias("signals_flagged"))
    two = briefs.agg(F.count_if(~F.col("generation_error")).alias("safety_briefs"))
    three = decisions.agg(n.alias("hitl_decisions"))
    return with_scalars(with_scalars(one, two), three)


def tier_distribution(briefs: DataFrame) -> DataFrame:
    return (
        briefs.filter(F.col("priority").isNotNull())
        .groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("priority")
    )


def decision_breakdown(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).orderBy("decision")


def run_metrics(
    briefs: DataFrame, input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE
) -> DataFrame:
    """One row: runs, tokens, mean literature score, empty and failed runs, cost."""
    totals = briefs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("tokens_out"),
        half_even(F.coalesce(F.avg("lit_score"), F.lit(0.0)), 4).alias("avg_lit_score"),
        F.count_if(F.col("lit_score") == 0).alias("zero_lit_runs"),
        F.count_if(F.col("generation_error")).alias("generation_errors"),
    )
    cost = (F.col("tokens_in") * input_price + F.col("tokens_out") * output_price) / 1_000_000
    return totals.withColumn("estimated_cost", half_even(cost, 4))


def coverage(counts: DataFrame, tiers: DataFrame, outcomes: DataFrame, depth: DataFrame) -> DataFrame:
    """One row of percentages from table counts, tier and decision tables, queue depth."""
    by_tier = tiers.agg(
        *[F.coalesce(F.sum(F.when(F.col("priority") == t, F.col("n"))), F.lit(0)).alias(f"_{t}")
          for t in scores.TIERS]
    )
    by_outcome = outcomes.agg(
        *[F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("n"))), F.lit(0)).alias(f"_{d}")
          for d in ("APPROVE", "REJECT")]
    )
    row = with_scalars(with_scalars(with_scalars(counts, by_tier), by_outcome), depth)
    c = F.col
    tier_total = sum((c(f"_{t}") for t in scores.TIERS), F.lit(0))
    decided = c("_APPROVE") + c("_REJECT")
    waiting_and_done = c("pending_briefs") + c("hitl_decisions")
    return row.select(
        scores.percent(c("safety_briefs"), c("signals_flagged")).alias("brief_coverage"),
        scores.percent(c("hitl_decisions"), c("safety_briefs")).alias("review_coverage"),
        *[scores.percent(c(f"_{t}"), tier_total).alias(f"{t.lower()}_share") for t in scores.TIERS],
        scores.percent(c("_APPROVE"), decided).alias("approve_share"),
        scores.percent(c("_REJECT"), decided).alias("reject_share"),
        scores.percent(c("pending_briefs"), waiting_and_done).alias("pending_share"),
        scores.percent(c("hitl_decisions"), waiting_and_done).alias("decided_share"),
    )


def reactions_per_drug(rows: DataFrame) -> DataFrame:
    """Sorted distinct reactions of each drug; distinct first, so lists hold terms only."""
    named = distinct_keys(rows, KEY).filter((F.col("drug_key") != "") & (F.col("pt") != ""))
    return named.groupBy("drug_key").agg(F.sort_array(F.collect_list("pt")).alias("reactions"))
