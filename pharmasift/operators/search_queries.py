"""Literature search queries of a signal: templates, validity, choice, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmasift.functions.text import json_strings, strip, unfence, words
from pharmasift.operators.joins import distinct_keys

# Number of queries, least words per query and the query endings.
QUERY_COUNT = 3
MIN_WORDS = 6
TEMPLATE_ENDINGS = (
    "mechanism pharmacology adverse reaction",
    "incidence risk factors clinical trial safety",
    "outcomes severity hospitalisation mortality",
)
SHORT_ENDINGS = ("", "adverse", "safety")


def template_queries(drug: Column, pt: Column, endings=TEMPLATE_ENDINGS) -> Column:
    """One query text per ending, drug and reaction first."""
    return F.array(
        *[F.concat_ws(" ", drug, pt, *([F.lit(e)] if e else [])) for e in endings]
    )


def valid_queries(queries: Column) -> Column:
    """Exactly three distinct non-blank texts of at least six words each."""
    trimmed = F.transform(queries, strip)
    long_enough = F.forall(queries, lambda q: F.size(words(q)) >= MIN_WORDS)
    ok = (
        (F.size(queries) == QUERY_COUNT)
        & F.forall(queries, lambda q: q.isNotNull())
        & long_enough
        & (F.size(F.array_distinct(trimmed)) == QUERY_COUNT)
    )
    return F.coalesce(ok, F.lit(False))


def choose_queries(signals: DataFrame, reply: str = "reply") -> DataFrame:
    """Generated queries when the reply parses and is valid, else the templates."""
    parsed = json_strings(unfence(F.col(reply)))
    fallback = template_queries(F.col("drug_key"), F.col("pt"))
    checked = signals.withColumn("_parsed", parsed)
    ok = valid_queries(F.col("_parsed"))
    return checked.withColumns(
        {
            "generated": ok,
            "search_queries": F.when(ok, F.transform("_parsed", strip)).otherwise(fallback),
        }
    ).drop("_parsed")


def query_rows(signals: DataFrame, keep: list[str]) -> DataFrame:
    """One row per query text; numbering starts at 1."""
    exploded = signals.select(*keep, F.posexplode("search_queries").alias("_p", "text"))
    return exploded.withColumn("query_no", F.col("_p") + 1).drop("_p")


def term_coverage(generated: DataFrame, share: float = 0.7) -> DataFrame:
    """Per generator: signals whose queries name at least one expected term.

    Input rows hold `generator`, `queries` (array) and `expected_terms` (array).
    """
    text = F.lower(F.array_join("queries", " "))
    found = F.filter("expected_terms", lambda t: text.contains(F.lower(t)))
    counted = generated.groupBy("generator").agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.count_if(F.size(found) >= 1).alias("n_with_terms"),
    )
    return counted.withColumn("ok", F.col("n_with_terms") >= F.col("n_signals") * share)


def retrieval_floor(signals: DataFrame, hits: DataFrame) -> DataFrame:
    """Per signal and generator: did anything come back at all?"""
    found = distinct_keys(hits, ["signal_id"]).withColumn("_hit", F.lit(True))
    return signals.join(found, "signal_id", "left").select(
        *signals.columns, F.coalesce("_hit", F.lit(False)).alias("ok")
    )
