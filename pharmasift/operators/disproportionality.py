"""2x2 tables, proportional reporting ratio and signal thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pharmasift.functions import scores
from pharmasift.operators.joins import dealt, shuffle_count, task_count, with_scalars

# Administrative terms that are never a signal.
JUNK_TERMS = (
    "drug ineffective",
    "drug ineffective for unapproved indication",
    "drug resistance",
    "therapeutic response decreased",
    "therapeutic response unexpected",
    "treatment failure",
    "no therapeutic response",
    "condition aggravated",
    "product use issue",
    "product quality issue",
    "product contamination issue",
    "device issue",
    "device malfunction",
    "off label use",
    "off-label use",
    "medication error",
    "no adverse event",
    "drug interaction",
    "intentional product use issue",
    "product use in unapproved indication",
    "inappropriate schedule of product administration",
    "drug administered to patient of inappropriate age",
    "expired product administered",
    "wrong technique in product usage process",
)


@dataclass(frozen=True)
class Thresholds:
    """Inclusive lower limits a pair has to reach."""

    prr: float
    cases: int
    other_cases: int
    drug_cases: int

    @classmethod
    def production(cls) -> Thresholds:
        return cls(prr=2.0, cases=50, other_cases=200, drug_cases=1000)

    @classmethod
    def relaxed(cls) -> Thresholds:
        return cls(prr=2.0, cases=30, other_cases=100, drug_cases=500)


def cell_counts(pairs: DataFrame, unique: bool = True) -> DataFrame:
    """Cell A and outcome sums per (drug, reaction).

    With `unique` the input holds one row per (report, drug, reaction), as the pair
    builder guarantees, and a plain count that combines before the shuffle is exact.
    """
    cases = F.count("primaryid") if unique else F.countDistinct("primaryid")
    return pairs.groupBy("drug_key", "pt").agg(
        cases.alias("a"),
        F.sum("death_flag").alias("death_count"),
        F.sum("hosp_flag").alias("hosp_count"),
        F.sum("lt_flag").alias("lt_count"),
    )


def drug_totals(pairs: DataFrame) -> DataFrame:
    """Distinct reports per drug.

    Spark aggregates on (drug, report) first and on the drug afterwards, so a drug
    with a third of all rows is still counted by many tasks.
    """
    return pairs.groupBy("drug_key").agg(F.countDistinct("primaryid").alias("drug_total"))


def reaction_totals(pairs: DataFrame) -> DataFrame:
    """Distinct reports per reaction."""
    return pairs.groupBy("pt").agg(F.countDistinct("primaryid").alias("reaction_total"))


def report_total(pairs: DataFrame) -> DataFrame:
    """One row: distinct reports overall."""
    return pairs.agg(F.countDistinct("primaryid").alias("n_total"))


def ratio_table(
    cells: DataFrame, by_drug: DataFrame, by_reaction: DataFrame, total: DataFrame
) -> DataFrame:
    """Cells A-D and the ratio; cells where the ratio is undefined are dropped. Other columns of the cells stay."""
    counts = ("drug_key", "pt", "a", "death_count", "hosp_count", "lt_count")
    joined = with_scalars(cells.join(by_drug, "drug_key").join(by_reaction, "pt"), total)
    counted = joined.select(
        "drug_key",
        "pt",
        "a",
        (F.col("drug_total") - F.col("a")).alias("b"),
        (F.col("reaction_total") - F.col("a")).alias("c"),
        (
            F.col("n_total") - F.col("drug_total") - F.col("reaction_total") + F.col("a")
        ).alias("d"),
        "drug_total",
        "reaction_total",
        "death_count",
        "hosp_count",
        "lt_count",
        *(c for c in cells.columns if c not in counts),
    )
    exposed = F.col("a") / (F.col("a") + F.col("b"))
    unexposed = F.col("c") / (F.col("c") + F.col("d"))
    defined = (
        (F.col("c") > 0)
        & (F.col("c") + F.col("d") > 0)
        & (F.col("a") + F.col("b") > 0)
    )
    return counted.filter(defined).withColumn("prr", exposed / unexposed)


def contingency(pairs: DataFrame, unique: bool = True) -> DataFrame:
    """2x2 table of every (drug, reaction) cell of a stored pairs table."""
    return ratio_table(
        cell_counts(pairs, unique), drug_totals(pairs), reaction_totals(pairs), report_total(pairs)
    )


#: Sums of a partial cell; the last three count each report once per drug, per reaction and over all.
PARTIAL_SUMS = ("a", "n_rows", "death_count", "hosp_count", "lt_count", "for_drug", "for_reaction", "for_all")


def marked(pairs: DataFrame) -> DataFrame:
    """Unique pairs with 0/1 marks: the one row of its report that counts for its drug, its reaction, and the total.

    One shuffle on the report into tasks of bounded input, or none where the pairs are stored bucketed by `primaryid`. Places in
    sorted reports make the marks, so no window holds a report's rows, and two sorts serve all three. `pairs.build` makes the
    same marks on its way, without this shuffle.
    """
    report = Window.partitionBy("primaryid").orderBy("drug_key", "pt")
    drug = Window.partitionBy("primaryid", "drug_key").orderBy("pt")
    reaction = Window.partitionBy("primaryid", "pt").orderBy("drug_key")
    windows = {"for_all": report, "for_drug": drug, "for_reaction": reaction}

    def with_marks(rows: DataFrame) -> DataFrame:
        for name, window in windows.items():
            rows = rows.withColumn(name, (F.row_number().over(window) == 1).cast("long"))
        return rows

    known = with_marks(pairs.filter(F.col("primaryid").isNotNull()))
    if shuffle_count(known) > shuffle_count(pairs):
        known = with_marks(dealt(pairs, task_count(pairs)))
    unknown = pairs.filter(F.col("primaryid").isNull())
    return known.unionByName(unknown.withColumns({name: F.lit(0).cast("long") for name in windows}))


def partial_cells(pairs: DataFrame, sign: int = 1) -> DataFrame:
    """PARTIAL_SUMS per (drug, reaction, period) of marked pairs; with sign -1 they take these pairs back."""
    sums = {
        "a": F.count("primaryid"), "n_rows": F.count(F.lit(1)), "death_count": F.sum("death_flag"), "hosp_count": F.sum("hosp_flag"),
        "lt_count": F.sum("lt_flag"), "for_drug": F.sum("for_drug"), "for_reaction": F.sum("for_reaction"), "for_all": F.sum("for_all"),
    }
    return pairs.groupBy("drug_key", "pt", "source_quarter").agg(*((sums[c] * sign).cast("long").alias(c) for c in PARTIAL_SUMS))


def marked_totals(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports per drug, per reaction and in all as sums of the marks, of marked pairs or partial cells."""
    return (
        rows.groupBy("drug_key").agg(F.sum("for_drug").alias("drug_total")),
        rows.groupBy("pt").agg(F.sum("for_reaction").alias("reaction_total")),
        rows.agg(F.sum("for_all").alias("n_total")),
    )


def contingency_of(partials: DataFrame) -> DataFrame:
    """2x2 table of every cell from stored partial cells: marginals are sums over the cells, whatever the number of reports."""
    cells = partials.groupBy("drug_key", "pt").agg(
        *(F.sum(c).alias(c) for c in ("a", "death_count", "hosp_count", "lt_count"))
    ).filter(F.col("a") > 0)
    return ratio_table(cells, *marked_totals(partials))


def threshold(
    cells: DataFrame, limits: Thresholds, junk: DataFrame | Sequence[str] = JUNK_TERMS
) -> DataFrame:
    """Cells that reach every limit and whose term is not on the junk list.

    A plain list of terms becomes part of the filter; a table is anti-joined.
    """
    passing = cells.filter(
        (F.col("a") >= limits.cases)
        & (F.col("c") >= limits.other_cases)
        & (F.col("drug_total") >= limits.drug_cases)
        & (F.col("prr") >= limits.prr)
    )
    if isinstance(junk, DataFrame):
        return passing.join(junk.select("pt").distinct(), "pt", "left_anti")
    return passing.filter(~F.col("pt").isin(list(junk)))


def signal_table(cells: DataFrame) -> DataFrame:
    """Output columns of the flagged-signal table, with the statistical score."""
    return cells.select(
        "drug_key",
        "pt",
        "prr",
        F.col("a").alias("drug_reaction_count"),
        F.col("b").alias("drug_no_reaction_count"),
        F.col("c").alias("other_reaction_count"),
        F.col("d").alias("other_no_reaction_count"),
        "death_count",
        "hosp_count",
        "lt_count",
        "drug_total",
        scores.stat_score(
            F.col("prr"), F.col("a"), F.col("death_count"), F.col("lt_count"), F.col("hosp_count")
        ).alias("stat_score"),
    )
