"""Literature investigation of all signals in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.functions import scores
from pharmasift.operators import retrieval, search_queries


def prepare(signals: DataFrame) -> DataFrame:
    """Signal state: severity text, template queries, statistical score if missing."""
    death, lt, hosp = F.col("death_count"), F.col("lt_count"), F.col("hosp_count")
    computed = scores.stat_score(F.col("prr"), F.col("drug_reaction_count"), death, lt, hosp)
    return signals.withColumns(
        {
            "signal_id": F.concat_ws("|", "drug_key", "pt"),
            "stat_score": F.coalesce(F.col("stat_score"), computed),
            "severity": scores.outcome_text(death, lt, hosp),
            "search_queries": search_queries.template_queries(F.col("drug_key"), F.col("pt")),
        }
    )


def retrieve(
    queries: DataFrame, docs: DataFrame, group: str = "group_key", top: int = retrieval.TOP_HITS,
    **options,
) -> DataFrame:
    """Best fused hits of every signal."""
    return retrieval.top_hits(retrieval.fuse(retrieval.search(queries, docs, group, **options)), top)


def assess(prepared: DataFrame, hits: DataFrame) -> DataFrame:
    """Literature score, tier, outcome line and action hint of prepared signals."""
    death, lt, hosp = F.col("death_count"), F.col("lt_count"), F.col("hosp_count")
    scored = retrieval.lit_scores(prepared, hits)
    return scored.withColumns(
        {
            "priority": scores.priority(F.col("stat_score"), F.col("lit_score")),
            "outcome_line": scores.outcome_line(death, lt, hosp),
            "action_hint": scores.action_hint(death, lt, hosp, F.col("prr")),
        }
    )


def investigate(
    signals: DataFrame,
    queries: DataFrame,
    docs: DataFrame,
    group: str = "group_key",
    top: int = retrieval.TOP_HITS,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Assessed signals and their kept hits.

    `queries` are the query rows of the signals (see `search_queries.query_rows`) with
    their embeddings; signals without query rows get no hits and a score of 0.
    """
    hits = retrieve(queries, docs, group, top, **options)
    return assess(prepare(signals), hits), hits
