"""Post-processing of written briefs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmasift.functions.scores import normalize_action
from pharmasift.operators import audit, quality


def audit_briefs(
    briefs: DataFrame,
    signals: DataFrame,
    evidence: DataFrame,
    similarity: Callable[[Column, Column], Column] = audit.word_overlap,
    years: tuple[int, int] = (2023, 2024),
) -> tuple[DataFrame, DataFrame]:
    """Audited valid briefs, and rejected ones with the rules they break.

    Order: normalize the action, check the record, strip citations that were not
    retrieved, then audit numbers, action and grounding and combine the scores.
    """
    key = list(audit.BRIEF_KEY)
    named = briefs.withColumn("recommended_action", normalize_action(F.col("recommended_action")))
    good, bad = quality.split_valid(named, quality.written_brief_rules())
    counts = signals.select(
        *key, "prr", F.col("drug_reaction_count").alias("case_count"),
        "death_count", "lt_count", "hosp_count",
    )
    known = audit.guard_citations(good, evidence).join(counts, key, "left")
    checked = audit.action_audit(audit.numeric_audit(known, years))
    grounded = audit.grounding_audit(checked, evidence, similarity)
    return audit.composite(grounded), bad
