"""Data-quality checks; each returns a small DataFrame and decides nothing itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Expected row ranges of a pairs table.
PERIOD_ROWS = (900_000, 1_800_000)
YEAR_ROWS = (4_000_000, 6_000_000)

Rule = tuple[str, Column]


def row_range(df: DataFrame, low: int, high: int) -> DataFrame:
    """One row: count, bounds and verdict ok / low / high."""
    n = F.col("n_rows")
    verdict = F.when(n < low, "low").when(n > high, "high").otherwise("ok")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        n, F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"),
        verdict.alias("verdict"),
    )


def required_pairs(pairs: DataFrame, required: DataFrame) -> DataFrame:
    """Rows per required pair and whether it is there; compares exactly."""
    keys = ["drug_key", "pt"]
    asked = pairs.join(required.select(*keys).distinct(), keys, "left_semi")  # few pairs are counted
    counted = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return required.select(*keys).join(counted, keys, "left").select(
        *keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.col("n_rows").isNotNull().alias("ok"),
    )


def required_signals(signals: DataFrame, required: Sequence[tuple[str, str]]) -> DataFrame:
    """Is there a signal whose drug and reaction contain the given texts?

    One pass with one conditional count per requirement.
    """
    def match(drug: str, pt: str) -> Column:
        return F.lower("drug_key").contains(drug.lower()) & F.lower("pt").contains(pt.lower())

    counts = signals.agg(
        *[F.count_if(match(d, p)).alias(f"n{i}") for i, (d, p) in enumerate(required)]
    )
    entry = [
        F.struct(F.lit(d).alias("drug_text"), F.lit(p).alias("pt_text"), F.col(f"n{i}").alias("n_rows"))
        for i, (d, p) in enumerate(required)
    ]
    rows = counts.select(F.explode(F.array(*entry)).alias("r")).select("r.*")
    return rows.withColumn("ok", F.col("n_rows") > 0)


def junk_left(signals: DataFrame, junk: Sequence[str]) -> DataFrame:
    """Junk terms that survived, with their counts; empty is good."""
    kept = signals.filter(F.col("pt").isin(list(junk)))
    return kept.groupBy("pt").agg(F.count(F.lit(1)).alias("n"))


def present_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: is it there, and in how many rows is it filled?

    Presence comes from the schema; the filled counts of all columns from one pass.
    """
    have = [c for c in required if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_n_{c}") for c in have])
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in have).alias("present"),
            (F.col(f"_n_{c}") if c in have else F.lit(0).cast("long")).alias("n_filled"),
        )
        for c in required
    ]
    return counts.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def readiness(pairs: DataFrame) -> DataFrame:
    """One row of violation counts for the scoring input: nulls, case, duplicates."""
    keys = ["primaryid", "drug_key", "pt"]
    copies = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    null_key = F.col("primaryid").isNull() | F.col("drug_key").isNull() | F.col("pt").isNull()
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(F.col("pt") != F.lower("pt"), F.col("n"))), F.lit(0)).alias("upper_terms"),
        F.coalesce(F.sum(F.when(F.col("drug_key") != F.lower("drug_key"), F.col("n"))), F.lit(0)).alias("upper_drugs"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
    )


# --- record rules ----------------------------------------------------------


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the names of the broken rules; a rule that evaluates to null is broken."""
    broken = F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
        )
    )
    return df.withColumn("violations", broken)


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of the broken rules."""
    judged = violations(df, rules)
    good = judged.filter(F.size("violations") == 0).drop("violations")
    return good, judged.filter(F.size("violations") > 0)


def _present(c: str) -> Rule:
    return f"{c} required", F.col(c).isNotNull()


def _range(c: str, low: float, high: float, nullable: bool) -> Rule:
    inside = F.col(c).between(low, high)
    return f"{c} in [{low:g}, {high:g}]", (F.col(c).isNull() | inside) if nullable else inside


def pair_rules() -> list[Rule]:
    flags = [(f"{c} is 0 or 1", F.col(c).isin(0, 1)) for c in ("death_flag", "hosp_flag", "lt_flag")]
    required = ("primaryid", "caseid", "drug_key", "pt", "source_quarter")
    return [*(_present(c) for c in required), *flags]


def signal_rules() -> list[Rule]:
    counts = (
        "drug_reaction_count", "drug_no_reaction_count", "other_reaction_count",
        "other_no_reaction_count", "drug_total", "death_count", "hosp_count", "lt_count",
    )
    return [
        _present("drug_key"), _present("pt"), ("prr > 0", F.col("prr") > 0),
        *[(f"{c} >= 0", F.col(c) >= 0) for c in counts],
    ]


def stored_brief_rules() -> list[Rule]:
    """Stored brief: tier needed unless generation failed, scores and tokens in range."""
    failed = F.coalesce("generation_error", F.lit(False))
    return [
        _present("drug_key"), _present("pt"),
        ("priority is P1-P4", failed | F.col("priority").isin("P1", "P2", "P3", "P4")),
        ("priority set", failed | F.col("priority").isNotNull()),
        _range("stat_score", 0, 1, True), _range("lit_score", 0, 1, True),
        *[(f"{c} >= 0", F.col(c).isNull() | (F.col(c) >= 0)) for c in ("input_tokens", "output_tokens")],
    ]


def written_brief_rules() -> list[Rule]:
    """Freshly written brief: all parts present, literal sets, one to five queries."""
    required = ("brief_text", "key_findings", "pmids_cited", "drug_key", "pt", "generated_at")
    return [
        *(_present(c) for c in required),
        ("search_queries has 1-5 entries", F.size("search_queries").between(1, 5)),
        (
            "recommended_action known",
            F.col("recommended_action").isin("MONITOR", "LABEL_UPDATE", "RESTRICT", "WITHDRAW"),
        ),
        ("priority is P1-P4", F.col("priority").isin("P1", "P2", "P3", "P4")),
        _range("stat_score", 0, 1, False), _range("lit_score", 0, 1, False),
    ]


def decision_rules(allowed: Sequence[str] = ("APPROVE", "REJECT")) -> list[Rule]:
    return [
        _present("drug_key"), _present("pt"),
        ("decision allowed", F.upper("decision").isin([a.upper() for a in allowed])),
    ]
