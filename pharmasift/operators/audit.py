"""Checks of written briefs against source numbers, tier rules and cited literature.

A brief row carries drug_key, pt, brief_text, pmids_cited, recommended_action,
priority and the source counts prr, case_count, death_count, lt_count, hosp_count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmasift.functions import scores
from pharmasift.functions.rounding import half_even
from pharmasift.functions.text import any_of, fixed, float_text, strip, tokens, words
from pharmasift.functions.vectors import term_cosine

# Tolerances, limits, weights, patterns and phrases of the checks.
PASS_BELOW = 0.20
WEIGHTS = {"numerical_accuracy": 0.40, "priority_consistency": 0.30, "citation_grounding": 0.30}
MIN_CLAIM_SIMILARITY = 0.50
RATIO_PATTERN = r"(?:prr|proportional reporting ratio)\s*(?:of|is|was|:|=)?\s*(\d+(?:\.\d+)?)"
NUMBER_PATTERN = r"(\d+(?:\.\d+)?)\s*([a-z\s]{0,30})"
PERCENT_PATTERN = r"(\d+(?:\.\d+)?)\s*%"
YEAR_PATTERN = r"\b(19\d{2}|20\d{2})\b"
DEATH_PATTERNS = (
    r"\d+\s+death", r"fatal\s+outcome", r"resulted\s+in\s+death", r"mortality\s+of\s+\d+"
)
NO_DEATH_PHRASES = ("no death", "zero death", "no fatal")
COUNT_WORDS = ("case", "report", "event")
CITATION_PATTERN = r"(?i)\[PMID[:\s]*(\d+)\]([^.]*\.)"
TIER_ACTIONS = {
    "P1": ("LABEL_UPDATE", "RESTRICT", "WITHDRAW", "MONITOR"),
    "P2": ("LABEL_UPDATE", "RESTRICT", "MONITOR"),
    "P3": ("LABEL_UPDATE", "MONITOR"),
    "P4": ("MONITOR", "LABEL_UPDATE"),
}

#: Presets: how much of an evidence text and of a claim the published audit looks at.
PUBLISHED_EVIDENCE_CHARS, PUBLISHED_CLAIM_CHARS = 500, 100
BRIEF_KEY = ("drug_key", "pt")
_STRINGS = "array<string>"


def _strings(*items: Column) -> Column:
    """Array of the non-null items."""
    return F.array_compact(F.array(*[i.cast("string") for i in items]))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# The messages in the functions below have to read exactly so, wording and order of parts included.

# --- numbers ---------------------------------------------------------------


def ratio_errors(text: Column, prr: Column) -> Column:
    """Ratios named in the text that are more than 10 % off."""
    claimed = F.transform(_all(text, RATIO_PATTERN), lambda v: v.cast("double"))
    wrong = F.filter(claimed, lambda v: F.abs(v - prr) > prr * 0.1)
    return F.transform(
        wrong,
        lambda v: F.concat(
            F.lit("Hallucinated PRR: claimed "), fixed(v, 2), F.lit(", actual "), fixed(prr, 2)
        ),
    )


def case_count_errors(text: Column, cases: Column) -> Column:
    """Counts above 10 followed by a case word that are more than 20 % off."""
    found = F.arrays_zip(
        _all(text, NUMBER_PATTERN, 1).alias("n"), _all(text, NUMBER_PATTERN, 2).alias("after")
    )
    counts = F.filter(
        found, lambda f: any_of(f["after"], list(COUNT_WORDS)) & (f["n"].cast("double") > 10)
    )
    def whole_text(f: Column) -> Column:
        n = f["n"].cast("double")
        # doubles this large have no fraction, and would not fit a long
        whole = F.when(n < 1e15, F.floor(n).cast("double")).otherwise(n)
        return F.format_string("%.0f", whole)

    whole = F.transform(counts, whole_text)
    wrong = F.filter(whole, lambda v: F.abs(v.cast("double") - cases) > cases * 0.2)
    return F.transform(
        wrong,
        lambda v: F.concat(
            F.lit("Hallucinated case count: claimed "), v,
            F.lit(", actual "), cases.cast("string"),
        ),
    )


def death_errors(text: Column, deaths: Column) -> Column:
    """Denied deaths that exist, or claimed deaths that do not."""
    denied = any_of(text, list(NO_DEATH_PHRASES))
    claimed = F.lit(False)
    for pattern in DEATH_PATTERNS:
        claimed = claimed | text.rlike(pattern)
    return _strings(
        F.when(
            (deaths > 0) & denied,
            F.concat(F.lit("Claims no deaths but "), deaths.cast("string"), F.lit(" deaths reported")),
        ),
        F.when((deaths == 0) & claimed, F.lit("Claims deaths occurred but data shows 0 deaths")),
    )


def percent_errors(text: Column) -> Column:
    values = F.transform(_all(text, PERCENT_PATTERN), lambda v: v.cast("double"))
    return F.transform(
        F.filter(values, lambda v: v > 100),
        lambda v: F.concat(F.lit("Invalid percentage: "), float_text(v), F.lit("% (exceeds 100%)")),
    )


def year_errors(text: Column, first: int = 2023, last: int = 2024) -> Column:
    years = F.transform(_all(text, YEAR_PATTERN), lambda v: v.cast("int"))
    return F.transform(
        F.filter(years, lambda y: (y < first) | (y > last)),
        lambda y: F.concat(
            F.lit("Suspicious date: "), y.cast("string"),
            F.lit(" (FAERS data is 2023, FDA comm may be 2024)"),
        ),
    )


def numeric_audit(briefs: DataFrame, years: tuple[int, int] = (2023, 2024)) -> DataFrame:
    """Add `numeric_errors` and `numeric_rate` (a third per error, at most 1)."""
    text = F.lower(F.coalesce("brief_text", F.lit("")))
    errors = F.concat(
        ratio_errors(text, F.coalesce("prr", F.lit(0.0))),
        case_count_errors(text, _zero("case_count")),
        death_errors(text, _zero("death_count")),
        percent_errors(text),
        year_errors(text, *years),
    )
    return briefs.withColumn("numeric_errors", errors).withColumn(
        "numeric_rate", F.least(F.size("numeric_errors") / F.lit(3.0), F.lit(1.0))
    )


# --- tier and action -------------------------------------------------------


def _quoted_list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def action_errors(
    tier: Column, action: Column, prr: Column, deaths: Column, lt: Column, hosp: Column
) -> Column:
    """Broken tier and action rules, in rule order."""
    ratio = fixed(prr, 2)
    allowed, listed = F.lit(False), F.lit("[]")
    for name, actions in TIER_ACTIONS.items():
        allowed = allowed | ((tier == name) & action.isin(*actions))
        listed = F.when(tier == name, _quoted_list(actions)).otherwise(listed)
    mismatch = F.concat(
        F.lit("Priority-action mismatch: "), F.coalesce(tier, F.lit("None")), F.lit(" should use "), listed,
        F.lit(", not "), F.coalesce(action, F.lit("None")),
    )

    def note(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    withdraw, restrict = action == "WITHDRAW", action == "RESTRICT"
    restrict_note = (
        F.when(
            (deaths == 0) & (lt == 0),
            "RESTRICT without deaths or life-threatening events — "
            "should be LABEL_UPDATE or MONITOR",
        )
        .when(
            (deaths > 0) & (prr < 2),
            note("RESTRICT with deaths but PRR < 2 (", ratio,
                 ") — threshold is PRR > 2 when deaths present"),
        )
        .when(
            (deaths == 0) & (lt > 0) & (prr < 5),
            note("RESTRICT with LT events but PRR < 5 (", ratio,
                 ") — threshold is PRR > 5 when only LT events (no deaths)"),
        )
    )
    serious = (deaths > 0) | (lt > 0) | (hosp > 0)
    return _strings(
        F.when(~F.coalesce(allowed, F.lit(False)), mismatch),
        F.when(
            withdraw & (deaths == 0), "WITHDRAW without deaths — should be RESTRICT or LABEL_UPDATE"
        ),
        F.when(
            withdraw & (prr < 10),
            note("WITHDRAW with low PRR (", ratio, ") — threshold is PRR > 10"),
        ),
        F.when(restrict, restrict_note),
        F.when(
            (action == "LABEL_UPDATE") & (prr < 2),
            note("LABEL_UPDATE with PRR < 2 (", ratio, ") — signal may not meet threshold"),
        ),
        F.when(
            (action == "MONITOR") & tier.isin("P1", "P2") & serious & (prr > 3),
            note(
                "MONITOR for ", tier, " signal with serious outcomes (deaths=",
                deaths.cast("string"), ", lt=", lt.cast("string"), ", hosp=", hosp.cast("string"),
                ") and PRR ", ratio, " — consider LABEL_UPDATE or RESTRICT",
            ),
        ),
    )


def action_audit(briefs: DataFrame) -> DataFrame:
    """Add `action_errors` and `action_rate` (half per error, at most 1)."""
    errors = action_errors(
        F.col("priority"), F.col("recommended_action"), F.coalesce("prr", F.lit(0.0)),
        _zero("death_count"), _zero("lt_count"), _zero("hosp_count"),
    )
    return briefs.withColumn("action_errors", errors).withColumn(
        "action_rate", F.least(F.size("action_errors") / F.lit(2.0), F.lit(1.0))
    )


# --- citations -------------------------------------------------------------


def cited_claims(briefs: DataFrame) -> DataFrame:
    """One row per inline citation: position, id and the rest of its sentence."""
    ids, claims = _all(F.col("brief_text"), CITATION_PATTERN, 1), _all(
        F.col("brief_text"), CITATION_PATTERN, 2
    )
    zipped = F.arrays_zip(ids.alias("pmid"), claims.alias("claim"))
    return briefs.select(*BRIEF_KEY, F.posexplode(zipped).alias("pos", "m")).select(
        *BRIEF_KEY, "pos", "m.pmid", strip(F.col("m.claim")).alias("claim")
    )


def word_overlap(claim: Column, evidence: Column) -> Column:
    """Term-frequency cosine; a lexical stand-in for an embedding similarity."""
    return term_cosine(tokens(claim), tokens(evidence))


def judge_claims(
    claims: DataFrame,
    evidence: DataFrame,
    similarity: Callable[[Column, Column], Column] = word_overlap,
    floor: float = MIN_CLAIM_SIMILARITY,
    evidence_chars: int | None = None,
) -> DataFrame:
    """Verdict per citation: short, unknown, ungrounded or grounded.

    The whole evidence is compared unless `evidence_chars` (published: PUBLISHED_EVIDENCE_CHARS) is given.

    `evidence` holds drug_key, pt, pmid, text. Pass a pandas UDF as `similarity` to
    compare embeddings instead of words.
    """
    known = evidence.groupBy(*BRIEF_KEY, F.trim("pmid").alias("pmid")).agg(
        F.max("text").alias("text")
    )
    joined = claims.join(known, [*BRIEF_KEY, "pmid"], "left")
    score = similarity(F.col("claim"), F.substring("text", 1, evidence_chars) if evidence_chars else F.col("text"))
    rated = joined.withColumn("similarity", F.when(F.col("text").isNotNull(), score))
    verdict = (
        F.when(F.size(words(F.col("claim"))) < 5, "short")
        .when(F.col("text").isNull(), "unknown")
        .when(F.col("similarity") < floor, "ungrounded")
        .otherwise("grounded")
    )
    return rated.withColumn("verdict", verdict).drop("text")


def grounding_audit(
    briefs: DataFrame,
    evidence: DataFrame,
    similarity: Callable[[Column, Column], Column] = word_overlap,
    floor: float = MIN_CLAIM_SIMILARITY,
    evidence_chars: int | None = None,
    claim_chars: int | None = None,
) -> DataFrame:
    """Add `grounding_errors` and `grounding_rate` (ungrounded share of all citations).

    Briefs without any evidence are reported but not penalised; short claims and
    unknown ids stay in the denominator only. Texts are read and quoted whole; the published
    lengths are PUBLISHED_EVIDENCE_CHARS and PUBLISHED_CLAIM_CHARS.
    """
    judged = judge_claims(cited_claims(briefs), evidence, similarity, floor, evidence_chars)
    message = F.when(
        F.col("verdict") == "unknown",
        F.concat(F.lit("Cited PMID "), F.col("pmid"), F.lit(" not in retrieved set")),
    ).when(
        F.col("verdict") == "ungrounded",
        F.concat(
            F.lit("Claim not grounded in PMID "), F.col("pmid"), F.lit(" (similarity "),
            fixed(F.col("similarity"), 2), F.lit(f" < {floor}): "),
            F.substring("claim", 1, claim_chars) if claim_chars else F.col("claim"),
        ),
    )
    order = F.when(F.col("verdict") == "unknown", 0).otherwise(1)
    per_brief = judged.groupBy(*BRIEF_KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("verdict") == "ungrounded").alias("_bad"),
        F.count_if(F.col("verdict") == "grounded").alias("_good"),
        F.sort_array(
            F.collect_list(F.when(message.isNotNull(), F.struct(order.alias("o"), "pos", message.alias("m"))))
        ).alias("_messages"),
    )
    has_evidence = evidence.groupBy(*BRIEF_KEY).agg(F.lit(True).alias("_any"))
    joined = briefs.join(per_brief, list(BRIEF_KEY), "left").join(
        has_evidence, list(BRIEF_KEY), "left"
    )
    some = F.coalesce("_any", F.lit(False))
    errors = F.when(
        some, F.coalesce(F.transform("_messages", lambda m: m["m"]), F.array().cast(_STRINGS))
    ).otherwise(F.array(F.lit("No abstracts available for grounding check")))
    rate = F.when(some, F.coalesce(F.try_divide("_bad", "_n"), F.lit(0.0))).otherwise(0.0)
    return joined.withColumns(
        {
            "grounding_errors": errors,
            "grounding_rate": rate,
            "grounded_claims": F.when(some, F.coalesce("_good", F.lit(0))).otherwise(0),
        }
    ).drop("_n", "_bad", "_good", "_messages", "_any")


# --- composite -------------------------------------------------------------


def composite(audited: DataFrame, pass_below: float = PASS_BELOW) -> DataFrame:
    """Weighted score (3 decimals), pass flag on the unrounded score, and all flags."""
    w = list(WEIGHTS.values())
    score = (
        F.col("numeric_rate") * w[0] + F.col("action_rate") * w[1] + F.col("grounding_rate") * w[2]
    )
    sources = dict(zip(WEIGHTS, ("numeric_errors", "action_errors", "grounding_errors")))

    def labelled(name: str, errors: str) -> Column:
        return F.transform(errors, lambda e: F.concat(F.lit(f"[{name}] "), e))

    flags = F.concat(*[labelled(name, errors) for name, errors in sources.items()])
    return audited.withColumns(
        {
            "audit_score": half_even(score, 3),
            "audit_pass": score < pass_below,
            "audit_flags": flags,
        }
    )


# --- citation guard --------------------------------------------------------


def guard_citations(briefs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Keep cited ids that were retrieved for the brief; count the removed ones.

    Works on one row per cited id, so briefs are never collected into one group of
    evidence; the kept ids of one brief return to their order.
    """
    cited = briefs.select(*BRIEF_KEY, F.posexplode("pmids_cited").alias("pos", "cited")).withColumn(
        "pmid", scores.bare_citation_id(F.col("cited"))
    )
    retrieved = evidence.select(
        *BRIEF_KEY, scores.bare_citation_id(F.col("pmid")).alias("pmid")
    ).distinct()
    kept = cited.join(retrieved, [*BRIEF_KEY, "pmid"], "left_semi")
    lists = kept.groupBy(*BRIEF_KEY).agg(
        F.sort_array(F.collect_list(F.struct("pos", "cited"))).alias("_kept")
    )
    before = F.coalesce(F.size("pmids_cited"), F.lit(0))
    clean = F.coalesce(F.transform("_kept", lambda k: k["cited"]), F.array().cast(_STRINGS))
    return (
        briefs.join(lists, list(BRIEF_KEY), "left")
        .withColumn("_before", before)
        .withColumn("pmids_cited", clean)
        .withColumn("citations_removed", F.col("_before") - F.size("pmids_cited"))
        .drop("_kept", "_before")
    )
