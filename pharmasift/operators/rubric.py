"""Four yes/no criteria for a written brief and the pass rate over the golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Actions each tier may recommend, patterns and target.
RUBRIC_ACTIONS = {
    "P1": ("WITHDRAW", "RESTRICT", "LABEL_UPDATE", "MONITOR"),
    "P2": ("RESTRICT", "LABEL_UPDATE", "MONITOR"),
    "P3": ("LABEL_UPDATE", "MONITOR"),
    "P4": ("MONITOR",),
}
MENTION_PATTERN = r"(?i)PMID[:\s]\d+"
MENTIONED_ID_PATTERN = r"(?i)PMID[:\s]?(\d{7,9})"
TARGET_RATE = 0.7
CRITERIA = (
    "signal_identification", "literature_grounding", "citation_accuracy", "tier_consistency"
)


# The reasons in the functions below have to read exactly so.


def _text() -> Column:
    return F.coalesce("brief_text", F.lit(""))


def _cited() -> Column:
    return F.coalesce("pmids_cited", F.array().cast("array<string>"))


def identifies_signal() -> tuple[Column, Column]:
    text = F.lower(_text())
    drug, pt = F.lower("drug_key"), F.lower("pt")
    has_drug, has_pt = text.contains(drug), text.contains(pt)
    missing = F.concat_ws(
        ", ",
        F.when(~has_drug, F.concat(F.lit("drug '"), drug, F.lit("'"))),
        F.when(~has_pt, F.concat(F.lit("reaction '"), pt, F.lit("'"))),
    )
    ok = has_drug & has_pt
    return ok, F.when(ok, "pass").otherwise(F.concat(F.lit("missing: "), missing))


def grounds_in_literature() -> tuple[Column, Column]:
    named = F.exists(_cited(), lambda p: _text().contains(p))
    pattern = _text().rlike(MENTION_PATTERN)
    reason = (
        F.when(named, F.concat(F.lit("pass ("), F.size(_cited()).cast("string"), F.lit(" PMIDs cited)")))
        .when(pattern, "pass (PMID pattern found in text)")
        .when(F.size(_cited()) == 0, "no PMIDs cited")
        .otherwise("PMIDs cited but none appear in brief_text")
    )
    return named | pattern, reason


def cites_accurately() -> tuple[Column, Column]:
    """Every 7-9 digit id in the text has to be in the cited list."""
    mentioned = F.array_distinct(
        F.regexp_extract_all(_text(), F.lit(MENTIONED_ID_PATTERN), F.lit(1))
    )
    invented = F.sort_array(F.array_except(mentioned, _cited()))
    reason = (
        F.when(F.size(mentioned) == 0, "pass (no PMIDs mentioned in text)")
        .when(
            F.size(invented) == 0,
            F.concat(F.lit("pass (all "), F.size(mentioned).cast("string"), F.lit(" cited PMIDs verified)")),
        )
        .otherwise(F.concat(F.lit("fabricated PMIDs: "), F.array_join(invented, ", ")))
    )
    return F.size(invented) == 0, reason


def matches_tier() -> tuple[Column, Column]:
    tier = F.upper(F.coalesce("priority", F.lit("")))
    action = F.upper(F.coalesce("recommended_action", F.lit("")))
    allowed, listed = F.lit(False), F.lit("")
    for name, actions in RUBRIC_ACTIONS.items():
        allowed = allowed | ((tier == name) & action.isin(*actions))
        listed = F.when(tier == name, ", ".join(actions)).otherwise(listed)
    missing = (tier == "") | (action == "")
    reason = (
        F.when(
            missing,
            F.concat(F.lit("missing priority='"), tier, F.lit("' or action='"), action, F.lit("'")),
        )
        .when(allowed, F.concat(F.lit("pass ("), tier, F.lit(" → "), action, F.lit(")")))
        .otherwise(
            F.concat(tier, F.lit(" cannot use "), action, F.lit(" (valid: "), listed, F.lit(")"))
        )
    )
    return allowed & ~missing, reason


def score_briefs(golden: DataFrame, briefs: DataFrame) -> DataFrame:
    """Criteria, reasons and overall verdict for every golden pair."""
    found = briefs.withColumn("_found", F.lit(True))
    joined = golden.select("drug_key", "pt").join(found, ["drug_key", "pt"], "left")
    present = F.coalesce("_found", F.lit(False))
    failed = F.coalesce("generation_error", F.lit(False))
    scorable = present & ~failed
    checks = dict(
        zip(CRITERIA, (identifies_signal(), grounds_in_literature(), cites_accurately(), matches_tier()))
    )
    why = F.when(~present, "brief not found").when(failed, "generation_error=True")
    columns, overall = [], scorable
    for name, (ok, reason) in checks.items():
        columns.append((scorable & ok).alias(name))
        columns.append(F.coalesce(why, reason).alias(f"{name}_reason"))
        overall = overall & ok
    return joined.select(
        "drug_key", "pt", "priority", "recommended_action",
        present.alias("found"), *columns, overall.alias("overall_pass"),
    )


def pass_rate(scored: DataFrame, target: float = TARGET_RATE) -> DataFrame:
    """One row: passes overall and per criterion, rate and whether the target is met."""
    n = F.count(F.lit(1))
    passes = F.count_if("overall_pass")
    return scored.agg(
        n.alias("total"),
        passes.alias("passes"),
        *[F.count_if(c).alias(f"{c}_passes") for c in CRITERIA],
        F.try_divide(passes, n).alias("pass_rate"),
        F.coalesce(F.try_divide(passes, n) >= target, F.lit(False)).alias("target_met"),
    )
