"""Drug rows: role filter, combination names, name map and one row per (report, drug)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.functions.text import blank_to_null, first_component, name_join_key
from pharmasift.operators.joins import attach, dealt, lookup_bytes


def load_name_map(raw: DataFrame) -> DataFrame:
    """Name map keyed like the drug rows, without unresolved names, unique on the key.

    Several raw names can share their first component after upper-casing and
    trimming; the smallest resolved name wins so that the join cannot multiply rows.
    """
    keyed = raw.filter(F.col("canonical_name").isNotNull()).select(
        name_join_key(F.col("prod_ai")).alias("prod_ai_upper"), "canonical_name", "rxcui"
    )
    picked = keyed.groupBy("prod_ai_upper").agg(
        F.min(F.struct("canonical_name", "rxcui")).alias("m")
    )
    return picked.select("prod_ai_upper", "m.canonical_name", "m.rxcui")


def suspect_rows(drug: DataFrame, roles: Sequence[str] = ("PS",)) -> DataFrame:
    """Rows whose role is one of `roles`, compared without case."""
    return drug.filter(F.upper("role_cod").isin([r.upper() for r in roles]))


def first_names(drug: DataFrame) -> DataFrame:
    """Both name columns cut to the first component; blank names become null."""
    return drug.withColumns(
        {
            c: blank_to_null(first_component(F.col(c)))
            for c in ("prod_ai", "drugname")
        }
    )


def resolve_names(drug: DataFrame, name_map: DataFrame) -> DataFrame:
    """Add `drug_key` (and the map's `rxcui`): mapped name, else ingredient, else product."""
    keyed = first_names(drug).withColumn("prod_ai_upper", F.upper(F.trim("prod_ai")))
    joined = attach(keyed, name_map, ["prod_ai_upper"], bound=lookup_bytes(name_map))
    key = F.coalesce(
        F.col("canonical_name"), F.lower(F.trim("prod_ai")), F.lower(F.trim("drugname"))
    )
    return joined.withColumn("drug_key", key).drop("prod_ai_upper", "canonical_name")


def normalize(
    drug: DataFrame, name_map: DataFrame, roles: Sequence[str] = ("PS",), tasks: int | None = None
) -> DataFrame:
    """Unique (primaryid, drug_key) rows with the smallest rxcui of their duplicates.

    With `tasks` the rows are dealt by report and stay so; rows without a report are left out then.
    """
    named = resolve_names(suspect_rows(drug, roles), name_map).filter(F.col("drug_key").isNotNull())
    if tasks is not None:
        named = dealt(named.select("primaryid", "drug_key", "rxcui"), tasks)
    return named.groupBy("primaryid", "drug_key").agg(F.min("rxcui").alias("rxcui"))


def distinct_names(drug: DataFrame) -> DataFrame:
    """Distinct upper-cased, trimmed ingredient names over all report files."""
    return (
        drug.filter(F.col("prod_ai").isNotNull())
        .select(F.upper(F.trim("prod_ai")).alias("prod_ai"))
        .distinct()
    )


def check_names(name_map: DataFrame, expected: DataFrame) -> DataFrame:
    """Spot check of raw name -> expected name: `ok` when the map contains the expectation."""
    joined = expected.join(
        name_map.select(F.col("prod_ai_upper").alias("raw_name"), "canonical_name"),
        "raw_name",
        "left",
    )
    actual = F.coalesce("canonical_name", F.lit("NOT FOUND"))
    found = F.col("canonical_name").isNotNull()
    return joined.select(
        "raw_name",
        "expected",
        actual.alias("actual"),
        (found & F.lower(actual).contains(F.col("expected"))).alias("ok"),
    )
