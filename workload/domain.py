"""The given tables seen as report entities, corpus, decisions and so on.

Each function reads whole tables. `stored_*` tables are written once per session to
the shared work folder, as the products they stand for are stored tables too.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmasift.operators import disproportionality as dp
from pharmasift.operators import naming, pairs
from pharmasift.operators.storage import fresh_path
from pharmasift.plans import flagging

LIMITS = dp.Thresholds(prr=1.2, cases=30, other_cases=100, drug_cases=200)
SMALL_LIMITS = dp.Thresholds(prr=1.2, cases=5, other_cases=20, drug_cases=10)
LATE = ("2001Q1", "2001Q2", "2001Q3")
JUNK = (*dp.JUNK_TERMS, "nation_3", "nation_17")
SPIKE_MAX = 0.12
#: For the smallest tables, whose pairs have few reports in each period.
SMALL_SPIKE_MAX = 0.5
LATE_MAX = 0.15
SMALL_LATE_MAX = 0.5

_lock = threading.RLock()
_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """Write the table on first use in this application, read it back afterwards."""
    tag = (spark.sparkContext.applicationId, sf_dir, name)
    with _lock:
        if tag not in _stored:
            digest = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
            path = fresh_path(spark, f"{name}-{digest}")
            make().write.parquet(path)
            _stored[tag] = path
    return spark.read.parquet(_stored[tag])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("primaryid"),
        F.expr("o_orderkey div 2").alias("caseid"),
        (F.col("o_orderkey") % 2 + 1).cast("int").alias("caseversion"),
        F.date_format(day, "yyyyMMdd").alias("fda_dt"),
        F.concat(F.year(day), F.lit("Q"), F.quarter(day)).alias("source_quarter"),
    )


def drug(spark, sf_dir) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    brand = F.upper("p_brand")
    ingredient = F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("string")).when(
        F.col("p_size") % 5 == 0, F.concat(brand, F.lit("\\"), F.upper("p_name"))
    ).otherwise(brand)
    role = (
        F.when(F.col("l_returnflag") == "A", "PS")
        .when(F.col("l_returnflag") == "R", "SS")
        .otherwise("C")
    )
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("primaryid"),
        F.expr("l_orderkey div 2").alias("caseid"),
        role.alias("role_cod"),
        ingredient.alias("prod_ai"),
        F.col("p_name").alias("drugname"),
    )


def reac(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return (
        li.join(s, li.l_suppkey == s.s_suppkey)
        .join(n, s.s_nationkey == n.n_nationkey)
        .select(F.col("l_orderkey").alias("primaryid"), F.col("n_name").alias("pt"))
    )


def outc(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    line = F.col("l_linenumber")
    code = F.when(line == 7, "DE").when(line == 6, "HO").when(line == 5, "LT").otherwise("OT")
    return li.select(F.col("l_orderkey").alias("primaryid"), code.alias("outc_cod"))


def raw_name_map(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .select(
            F.upper("p_brand").alias("prod_ai"),
            F.lower("p_brand").alias("canonical_name"),
            F.concat(F.lit("RX"), F.substring_index("p_brand", "#", -1)).alias("rxcui"),
        )
        .distinct()
    )


def name_map(spark, sf_dir) -> DataFrame:
    return naming.load_name_map(raw_name_map(spark, sf_dir))


def build_pairs(spark, sf_dir, marks: bool = False) -> DataFrame:
    return pairs.build(
        demo(spark, sf_dir), drug(spark, sf_dir), reac(spark, sf_dir), outc(spark, sf_dir),
        name_map(spark, sf_dir), marks=marks,
    )


def marked_pairs(spark, sf_dir) -> DataFrame:
    """The stored pairs with their marks."""
    return stored(spark, sf_dir, "pairs", lambda: build_pairs(spark, sf_dir, marks=True))


def stored_pairs(spark, sf_dir) -> DataFrame:
    return marked_pairs(spark, sf_dir).select(*pairs.PAIR_COLUMNS)


def flagged(spark, sf_dir) -> DataFrame:
    return flagging.flag(
        marked_pairs(spark, sf_dir), LIMITS, JUNK, SPIKE_MAX, LATE, LATE_MAX, marked=True
    )


def stored_signals(spark, sf_dir) -> DataFrame:
    return stored(spark, sf_dir, "signals", lambda: flagged(spark, sf_dir))


# --- briefs, evidence, decisions, golden pairs ------------------------------


def _claim(text) -> F.Column:
    """First sentence of a text."""
    return F.substring_index(text, ".", 1)


def evidence(spark, sf_dir) -> DataFrame:
    """Three documents per signal as its retrieved literature, spread over the whole table."""
    from pharmasift.operators.joins import with_scalars

    s = stored_signals(spark, sf_dir).select(
        "drug_key", "pt", F.col("drug_reaction_count").alias("a"), F.col("other_reaction_count").alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = with_scalars(s, docs.agg(F.count(F.lit(1)).alias("n_docs")))
    return s.join(docs, F.expr("(a * 7919 + c * 31 + j * 104729) % n_docs") == F.col("doc_id")).select(
        "drug_key", "pt", "j", (F.col("a") + F.col("j") + 1000000).cast("string").alias("pmid"), "text"
    )


def briefs(spark, sf_dir) -> DataFrame:
    """Deterministic briefs with planted faults; the length of its key leaves a signal uninvestigated."""
    from pharmasift.functions import scores
    from pharmasift.functions.text import fixed
    from pharmasift.operators.search_queries import template_queries

    s = stored_signals(spark, sf_dir).filter(F.length(F.concat("drug_key", "pt")) % 5 != 0)
    claims = evidence(spark, sf_dir)
    first = claims.filter(F.col("j") == 0).select("drug_key", "pt", _claim(F.col("text")).alias("claim0"))
    second = claims.filter(F.col("j") == 1).select("drug_key", "pt", _claim(F.col("text")).alias("claim1"))
    s = s.join(first, ["drug_key", "pt"]).join(second, ["drug_key", "pt"])
    a = F.col("drug_reaction_count")
    lit = (a % 10) / 10.0
    p0, p1, p9 = [(a + n).cast("string") for n in (1000000, 1000001, 2000000)]
    ratio = F.when(a % 5 == 0, fixed(F.col("prr") * 1.5, 1)).otherwise(fixed(F.col("prr"), 2))
    cases = F.when(a % 4 == 0, a * 2).otherwise(a).cast("string")
    deaths = F.when(a % 6 == 0, F.lit("No deaths were seen.")).otherwise(
        F.concat(F.col("death_count").cast("string"), F.lit(" deaths occurred."))
    )
    extra = F.when(a % 9 == 0, F.lit(" Incidence rose by 140.5% since 2019.")).otherwise("")
    text = F.concat(
        F.initcap("drug_key"), F.lit(" with "), F.col("pt"), F.lit(" shows a PRR of "), ratio,
        F.lit(" based on "), cases, F.lit(" reports in 2023. "), deaths, extra,
        F.lit(" [PMID:"), p0, F.lit("] "), F.col("claim0"), F.lit(". [PMID: "), p1, F.lit("] "),
        F.when(a % 2 == 0, F.lit("the mechanism of this reaction remains entirely unclear")).otherwise(F.col("claim1")),
        F.lit(". [PMID:"), F.when(a % 3 == 0, p9).otherwise(p0), F.lit("] see there."),
    )
    cited = F.concat(
        F.array(F.concat(F.lit("PMID:"), p0), p1),
        F.when(a % 3 == 0, F.array(p9)).otherwise(F.array().cast("array<string>")),
    )
    action = (
        F.when(a % 7 == 0, "withdraw from market")
        .when(a % 5 == 1, "Consider label revision")
        .when(a % 3 == 0, "RESTRICT FOR PATIENTS OR REMOVE")
        .when(a % 2 == 0, "restrict use")
        .otherwise("monitor")
    )
    findings = F.when(a % 13 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('["'), F.col("pt"), F.lit('", "n='), a.cast("string"), F.lit('"]'))
    )
    return s.select(
        (a * 1000000 + F.col("other_reaction_count")).alias("brief_id"),
        "drug_key", "pt", "stat_score", lit.alias("lit_score"),
        scores.priority(F.col("stat_score"), lit).alias("priority"),
        text.alias("brief_text"),
        findings.alias("key_findings"),
        cited.alias("pmids_cited"),
        template_queries(F.col("drug_key"), F.col("pt")).alias("search_queries"),
        action.alias("recommended_action"),
        F.lit("m1").alias("model_used"),
        (a * 10).alias("input_tokens"),
        F.col("other_reaction_count").alias("output_tokens"),
        (a % 11 == 0).alias("generation_error"),
        F.timestamp_seconds(a + 1704067200).alias("generated_at"),
    )


def stored_briefs(spark, sf_dir) -> DataFrame:
    return stored(spark, sf_dir, "briefs", lambda: briefs(spark, sf_dir))


def submitted_decisions(spark, sf_dir) -> DataFrame:
    """All events as submitted decisions, most of them with a value nobody may submit."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("brand#"), (F.col("user_id") % 100 + 1).cast("string")).alias("drug_key"),
        F.concat(F.lit("nation_"), (F.col("event_id") % 100).cast("string")).alias("pt"),
        F.when(kind == "purchase", "approve").when(kind == "error", "REJECT").otherwise(kind).alias("decision"),
        F.col("props").alias("reviewer_note"),
        F.col("ts").alias("decided_at"),
    )


def decisions(spark, sf_dir) -> DataFrame:
    from pharmasift.sources.tables import split_decisions

    return split_decisions(submitted_decisions(spark, sf_dir))[0]


def golden(spark, sf_dir) -> DataFrame:
    """Drug and reaction pairs that occur together as brand and size of a part."""
    p, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    number = F.substring_index("p_brand", "#", -1).cast("int")
    pairs_ = p.join(n, F.col("p_size") % 25 == F.col("n_nationkey")).select(
        F.lower("p_brand").alias("drug_key"), F.lower("n_name").alias("pt"),
        number.alias("b"), F.col("n_nationkey").alias("k"),
    ).distinct()
    late = F.date_add(F.lit("1997-01-01").cast("date"), F.col("b") * 30 + F.col("k"))
    early = F.date_add(F.lit("1995-01-02").cast("date"), F.col("b"))
    when = F.when(F.col("b") % 12 == 0, F.lit(None).cast("date")).when(F.col("k") % 4 == 1, early).otherwise(late)
    return pairs_.select(
        "drug_key", "pt", when.alias("comm_date"), F.concat(F.lit("Notice "), F.col("b").cast("string")).alias("comm_label")
    )


# --- literature --------------------------------------------------------------


def corpus(spark, sf_dir) -> DataFrame:
    """All documents; those without a vector are grouped by their id and can be found by words."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        "doc_id", F.coalesce("label", F.col("doc_id") % 10).cast("string").alias("group_key"), "text", "embedding"
    )


def library(spark, sf_dir) -> DataFrame:
    """All documents, grouped by source; no vectors."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("group_key"), "text"
    )


def _items(spark, sf_dir) -> DataFrame:
    from pharmasift.operators.joins import with_scalars

    b = table(spark, sf_dir, "benchmark")
    rows = with_scalars(b, b.agg(F.count(F.lit(1)).alias("n"))).select(
        "item_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("query_no"), "n"
    )
    other = b.select(F.col("item_id").alias("_i"), "text")
    return rows.join(other, F.expr("(item_id + query_no - 1) % n") == F.col("_i")).select(
        "item_id", "query_no", "text"
    )


def literature_queries(spark, sf_dir) -> DataFrame:
    """Three query rows per benchmark item, with text and vector."""
    return stored(spark, sf_dir, "queries", lambda: _literature_queries(spark, sf_dir))


def _literature_queries(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    items = _items(spark, sf_dir)
    return items.join(e, F.expr("item_id * 3 + query_no - 1") == F.col("vec_id")).select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("signal_id"),
        "query_no", (F.col("item_id") % 10).cast("string").alias("group_key"), "text", "embedding",
    )


def library_queries(spark, sf_dir) -> DataFrame:
    return stored(spark, sf_dir, "library-queries", lambda: _library_queries(spark, sf_dir))


def _library_queries(spark, sf_dir) -> DataFrame:
    return _items(spark, sf_dir).select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("signal_id"),
        "query_no", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("group_key"),
        "text",
    )


def vector_queries(spark, sf_dir) -> DataFrame:
    """Every vector as a query in its own label."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("signal_id"),
        F.lit(1).alias("query_no"), F.col("label").cast("string").alias("group_key"), "embedding",
    )


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("group_key"), "embedding"
    )


def stored_hits(spark, sf_dir) -> DataFrame:
    """All result lists of the literature queries."""
    from pharmasift.operators import retrieval

    return stored(
        spark, sf_dir, "hits",
        lambda: retrieval.search(
            literature_queries(spark, sf_dir), corpus(spark, sf_dir), min_similarity=0.2
        ),
    )


def item_signals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("signal_id")
    )


def calls(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("call_id"),
        "ts",
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type").isin("view", "click"), "query_generation")
        .otherwise("brief_generation").alias("task"),
        F.floor(F.col("value") * 100).alias("input_tokens"),
        F.col("user_id").alias("output_tokens"),
    )
