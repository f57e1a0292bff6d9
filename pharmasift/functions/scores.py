"""Scores, tiers, bands and the short texts derived from outcome counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pharmasift.functions.rounding import half_even
from pharmasift.functions.text import fixed

# Score weights and limits.
PRR_FULL_SCORE = 4.0
CASES_FULL_SCORE = 50
STAT_WEIGHTS = (0.50, 0.30, 0.20)
SEVERITY = {"death": 1.0, "life_threatening": 0.75, "hospital": 0.50}
LIT_WEIGHTS = (0.70, 0.30)
LIT_FULL_COUNT = 5
LIT_SPARSE_ONLY = 0.65
STAT_TIER_LIMIT = 0.7
LIT_TIER_LIMIT = 0.5
TIERS = ("P1", "P2", "P3", "P4")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def stat_score(prr: Column, cases: Column, death: Column, lt: Column, hosp: Column) -> Column:
    """Weighted ratio, volume and severity in [0, 1], four decimals."""
    w_ratio, w_volume, w_severity = STAT_WEIGHTS
    ratio = F.least(prr / F.lit(PRR_FULL_SCORE), F.lit(1.0))
    volume = F.least(
        F.log10(F.greatest(cases, F.lit(1)).cast("double")) / F.lit(math.log10(CASES_FULL_SCORE)),
        F.lit(1.0),
    )
    severity = (
        F.when(_zero(death) != 0, SEVERITY["death"])
        .when(_zero(lt) != 0, SEVERITY["life_threatening"])
        .when(_zero(hosp) != 0, SEVERITY["hospital"])
        .otherwise(0.0)
    )
    return half_even(
        ratio * F.lit(w_ratio) + volume * F.lit(w_volume) + severity * F.lit(w_severity), 4
    )


def lit_score(mean_dense_similarity: Column, hits: Column) -> Column:
    """Literature score from the mean dense similarity (null: sparse hits only) and hit count."""
    w_relevance, w_volume = LIT_WEIGHTS
    relevance = F.coalesce(mean_dense_similarity, F.lit(LIT_SPARSE_ONLY))
    volume = F.least(hits / F.lit(float(LIT_FULL_COUNT)), F.lit(1.0))
    scored = half_even(relevance * F.lit(w_relevance) + volume * F.lit(w_volume), 4)
    return F.when(_zero(hits) == 0, F.lit(0.0)).otherwise(scored)


def priority(stat: Column, lit: Column) -> Column:
    strong = stat >= STAT_TIER_LIMIT
    supported = lit >= LIT_TIER_LIMIT
    return (
        F.when(strong & supported, "P1").when(strong, "P2").when(supported, "P3").otherwise("P4")
    )


def tier_rank(tier: Column, unknown: int = len(TIERS) + 1) -> Column:
    """1..4 for the known tiers, `unknown` for anything else."""
    rank = F.lit(unknown)
    for position, name in reversed(list(enumerate(TIERS, start=1))):
        rank = F.when(tier == name, position).otherwise(rank)
    return rank


def stat_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def lit_band(score: Column) -> Column:
    return F.when(score >= 0.5, "high").when(score >= 0.3, "medium").otherwise("low")


def lead_class(lead_days: Column, flagged: Column) -> Column:
    """Where a detection stands relative to the notice date."""
    return (
        F.when(lead_days.isNull(), "not_detected")
        .when(~flagged, "not_flagged")
        .when(lead_days > 0, "before_notice")
        .otherwise("after_notice")
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; 0 when the whole is zero or missing."""
    share = half_even(F.try_divide(part, whole) * F.lit(100.0), 1)
    return F.coalesce(share, F.lit(0.0))


# The outcome and hint sentences in the functions below have to read exactly so.


def outcome_text(
    death: Column,
    lt: Column,
    hosp: Column,
    life_threatening_label: str = "life-threatening",
    default: str = "no serious outcomes reported",
) -> Column:
    """Comma-joined outcome counts in the order deaths, life-threatening, hospital."""
    parts = [(death, "deaths"), (lt, life_threatening_label), (hosp, "hospitalisations")]
    joined = F.concat_ws(
        ", ",
        *[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {label}"))) for n, label in parts],
    )
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def outcome_line(death: Column, lt: Column, hosp: Column) -> Column:
    """The longer outcome sentence that heads an evidence summary."""
    return F.concat(
        F.lit("Serious outcomes: "),
        outcome_text(death, lt, hosp, "life-threatening events", "none reported"),
    )


def action_hint(death: Column, lt: Column, hosp: Column, prr: Column) -> Column:
    """Which action the outcome counts and the ratio point to; empty when none."""
    deaths, lts, hosps, ratio = _zero(death), _zero(lt), _zero(hosp), F.coalesce(prr, F.lit(0.0))
    ratio_text = fixed(ratio, 2)
    n_death, n_lt = deaths.cast("string"), lts.cast("string")
    withdraw = F.concat(
        F.lit("⚠ WITHDRAW criteria may be met: "), n_death,
        F.lit(" deaths reported with PRR "), ratio_text, F.lit(" > 10"),
    )
    restrict_deaths = F.concat(
        F.lit("⚠ RESTRICT criteria may be met: "), n_death,
        F.lit(" deaths reported with PRR "), ratio_text,
        F.lit(" > 2 — consider whether use should be limited to specific populations"),
    )
    restrict_lt = F.concat(
        F.lit("⚠ RESTRICT criteria may be met: "), n_lt,
        F.lit(" life-threatening events with PRR "), ratio_text,
    )
    mild = F.lit(
        "ℹ No serious outcomes reported and PRR below 5 — "
        "consider whether MONITOR is appropriate if reaction is mild and self-limiting"
    )
    none_serious = (deaths == 0) & (lts == 0) & (hosps == 0)
    return (
        F.when((deaths > 0) & (ratio > 10), withdraw)
        .when((deaths > 0) & (ratio > 2), restrict_deaths)
        .when((lts > 0) & (ratio > 2), restrict_lt)
        .when(none_serious & (ratio < 5), mild)
        .otherwise("")
    )


def normalize_action(raw: Column) -> Column:
    """Map free action text onto the four actions; the order of the tests matters."""
    from pharmasift.functions.text import any_of, strip

    action = strip(F.upper(F.coalesce(raw, F.lit(""))))
    return (
        F.when(action == "", "MONITOR")
        .when(action.contains("OR") & (F.length(action) > 20), "MONITOR")
        .when(action.isin("MONITOR", "LABEL_UPDATE", "RESTRICT", "WITHDRAW"), action)
        .when(any_of(action, ["WITHDRAW", "REMOVE"]), "WITHDRAW")
        .when(any_of(action, ["RESTRICT", "LIMIT"]), "RESTRICT")
        .when(any_of(action, ["LABEL", "UPDATE", "REVISE"]), "LABEL_UPDATE")
        .otherwise("MONITOR")
    )


def bare_citation_id(c: Column) -> Column:
    """Citation id without surrounding space and leading label characters."""
    return F.trim(F.ltrim(F.trim(c), F.lit("PMID:")))
