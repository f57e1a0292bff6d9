"""Registered queries: a Spark callable and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmasift.functions import scores
from pharmasift.functions.rounding import half_even
from pharmasift.functions.text import contains_ci, name_join_key, tokens
from pharmasift.functions.vectors import cosine
from pharmasift.operators import audit, cases, corpus, evaluate, feed_store, joins, ledger, naming, pairs, quality
from pharmasift.operators import disproportionality as dp
from pharmasift.operators import retrieval, review, rubric, search_queries, storage, substring_index, temporal, text_index, vector_index
from pharmasift.operators.joins import with_scalars
from pharmasift.plans import brief_audit, flagging, incremental, investigation
from pharmasift.sources import messages, reports, tables
from pharmasift.streaming import ingest
from workload import domain as d
from workload.sql import STAT, compose, fix, norm_action, outcome_parts, pct, priority, rnd, tier_rank, tokens as sql_tokens

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, compose(sql) if sql else None)
        return fn

    return add


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def moment(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def joined(c: str, alias: str | None = None):
    return F.array_join(c, " | ").alias(alias or c)


DAY = "strftime({0}, '%Y-%m-%d') AS {0}"
MOMENT = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
LIST = "array_to_string({0}, ' | ') AS {0}"
FEED_COLUMNS = (
    "drug_key", "pt", "prr", "stat_score", "drug_reaction_count", "death_count",
    "lit_score", "priority", "generation_error", "hitl_decision",
)
FEED_SQL = ", ".join(FEED_COLUMNS)


def feed(s, p):
    return review.feed_rows(d.stored_signals(s, p), d.stored_briefs(s, p), d.decisions(s, p)).select(*FEED_COLUMNS)


# --- reading, messages, tables ----------------------------------------------


@query("report_files", f"""SELECT CAST(primaryid AS VARCHAR) AS primaryid, CAST(caseid AS VARCHAR) AS caseid,
    CAST(caseversion AS VARCHAR) AS caseversion, fda_dt, source_quarter FROM demo
    WHERE source_quarter LIKE '1997%' AND right(source_quarter, 1) IN ('1', '3')""")
def _(s, p):
    path = d.fresh_path(s, "files")
    demo = d.demo(s, p)
    first = F.col("source_quarter").endswith("1")
    for rows, order in ((demo.where(first), demo.columns), (demo.where(~first), demo.columns[::-1])):  # two headers
        (
            rows.select(*order).withColumn("folder", F.col("source_quarter")).drop("source_quarter")
            .write.mode("append").partitionBy("folder").option("sep", "$").option("header", True)
            .option("encoding", "ISO-8859-1").option("escape", '"').csv(f"{path}/{'a' if order is demo.columns else 'b'}")
        )
    return reports.select_periods(reports.read_files(s, path), year=1997, quarters=[1, 3]).select(
        "primaryid", "caseid", "caseversion", "fda_dt", "source_quarter"
    )


@query("message_parse", "SELECT primaryid, caseid, caseversion, fda_dt, source_quarter FROM demo")
def _(s, p):
    return messages.parse_entity(messages.to_messages(d.demo(s, p)), messages.SPECS["DEMO"])


@query("message_parse_drug", """SELECT primaryid, caseid, role_cod, prod_ai, drugname FROM drug""")
def _(s, p):
    raw = messages.to_messages(d.drug(s, p))
    return messages.parse_entity(raw, messages.SPECS["DRUG"]).drop("source_quarter")


@query("message_parse_reac_outc", """SELECT 'REAC' AS entity, pt AS term, count(*) AS n, count(DISTINCT primaryid) AS reports
    FROM reac GROUP BY 2 UNION ALL
    SELECT 'OUTC', outc_cod, count(*), count(DISTINCT primaryid) FROM outc GROUP BY 2""")
def _(s, p):
    def tally(entity, df, column):
        parsed = messages.parse_entity(messages.to_messages(df), messages.SPECS[entity])
        return parsed.groupBy(F.col(column).alias("term")).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("primaryid").alias("reports")
        ).select(F.lit(entity).alias("entity"), "term", "n", "reports")

    return tally("REAC", d.reac(s, p), "pt").unionByName(tally("OUTC", d.outc(s, p), "outc_cod"))


@query("message_files", "SELECT primaryid, caseid, caseversion, fda_dt, source_quarter FROM demo WHERE source_quarter = '1998Q2'")
def _(s, p):
    path = d.fresh_path(s, "messages")
    messages.to_messages(d.demo(s, p)).write.text(path)
    return messages.parse_entity(messages.read_text(s, path), messages.SPECS["DEMO"], "1998Q2")


def _quarters(s, p):
    demo = d.demo(s, p).select("primaryid", "source_quarter")
    by_report = lambda df: df.select("primaryid").join(demo, "primaryid")
    return {
        "DEMO": demo, "DRUG": by_report(d.drug(s, p)),
        "REAC": by_report(d.reac(s, p)), "OUTC": by_report(d.outc(s, p)),
    }


COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{e}' AS entity, source_quarter, count(*) AS n_rows FROM {t} GROUP BY source_quarter"
    if e == "DEMO" else
    f"SELECT '{e}', source_quarter, count(*) FROM {t} JOIN demo USING (primaryid) GROUP BY source_quarter"
    for e, t in (("DEMO", "demo"), ("DRUG", "drug"), ("REAC", "reac"), ("OUTC", "outc"))
)


@query("entity_row_counts", COUNTS_SQL)
def _(s, p):
    return reports.entity_counts(_quarters(s, p))


@query("missing_entities", """SELECT source_quarter, 'LATE' AS entity FROM (SELECT DISTINCT source_quarter FROM demo)
    WHERE source_quarter NOT LIKE '2001%'""")
def _(s, p):
    frames = {"DEMO": d.demo(s, p)}
    frames["LATE"] = d.demo(s, p).filter(F.col("source_quarter").isin(*d.LATE))
    return reports.missing_entities(reports.entity_counts(frames), ("DEMO", "LATE"))


@query("unpublished_periods", """SELECT source_quarter, count(*) AS n FROM demo WHERE source_quarter NOT IN
    (SELECT source_quarter FROM demo WHERE fda_dt < '19970101') GROUP BY 1""")
def _(s, p):
    demo = d.demo(s, p)
    published = demo.filter(F.col("fda_dt") < "19970101")
    return reports.unpublished(demo, published).groupBy("source_quarter").agg(F.count(F.lit(1)).alias("n"))


@query("row_cap", """SELECT value FROM (SELECT '{"primaryid":"' || CAST(primaryid AS VARCHAR) || '","fda_dt":"' || fda_dt || '"}' AS value FROM demo)
    ORDER BY value LIMIT 100""")
def _(s, p):
    path = d.fresh_path(s, "capped")
    messages.to_messages(d.demo(s, p).select("primaryid", "fda_dt")).write.text(path)
    return messages.read_text(s, path, 100)


@query("name_map_load", "SELECT prod_ai_upper, canonical_name, rxcui FROM name_map")
def _(s, p):
    return d.name_map(s, p)


@query("pairs_projection", """SELECT drug_key, source_quarter, count(*) AS n, CAST(sum(death_flag) AS BIGINT) AS deaths
    FROM pairs GROUP BY 1, 2""")
def _(s, p):
    return d.stored_pairs(s, p).groupBy("drug_key", "source_quarter").agg(
        F.count(F.lit(1)).alias("n"), F.sum("death_flag").alias("deaths")
    )


@query("append_new_pairs", """SELECT source_quarter, count(*) AS n FROM pairs
    WHERE primaryid NOT IN (SELECT primaryid FROM pairs WHERE fda_dt < DATE '1998-01-01') GROUP BY 1""")
def _(s, p):
    everything = d.stored_pairs(s, p)
    held = everything.filter(F.col("fda_dt") < "1998-01-01")
    new = tables.new_rows(everything, held, tables.PAIR_KEY)
    return new.groupBy("source_quarter").agg(F.count(F.lit(1)).alias("n"))


@query("append_pairs_twice", "SELECT count(*) AS n_rows, count(DISTINCT (primaryid, drug_key, pt)) AS n_keys FROM pairs")
def _(s, p):
    path = d.fresh_path(s, "append")
    everything = d.stored_pairs(s, p)
    tables.append_new(everything.filter(F.col("fda_dt") < "1998-01-01"), path, partition="source_quarter")
    tables.append_new(everything, path, partition="source_quarter")
    tables.append_new(everything, path, partition="source_quarter")
    return s.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("primaryid", "drug_key", "pt").alias("n_keys")
    )


@query("replace_signals", "SELECT drug_key, pt, prr, stat_score FROM signals")
def _(s, p):
    root = d.fresh_path(s, "replaced")
    old = tables.replace(d.stored_signals(s, p).withColumn("prr", F.col("prr") / 2), root)
    return tables.replace(old.withColumn("prr", F.col("prr") * 2), root).select("drug_key", "pt", "prr", "stat_score")


UPSERT_SQL = """SELECT drug_key, pt, lit_score, 'old' AS origin FROM briefs WHERE lit_score < 0.5
    UNION ALL SELECT drug_key, pt, lit_score / 2 AS lit_score, 'new' FROM briefs WHERE lit_score >= 0.5"""


@query("upsert_briefs", UPSERT_SQL)
def _(s, p):
    b = d.stored_briefs(s, p).select("drug_key", "pt", "lit_score")
    target = b.withColumn("origin", F.lit("old"))
    source = b.filter(F.col("lit_score") >= 0.5).select(
        "drug_key", "pt", (F.col("lit_score") / 2).alias("lit_score"), F.lit("new").alias("origin")
    )
    return tables.upsert(target, source, tables.SIGNAL_KEY)


@query("upsert_briefs_by_bucket", UPSERT_SQL)
def _(s, p):
    """The same into a stored table, bucket by bucket, with part of the source upserted twice."""
    b, path = d.stored_briefs(s, p).select("drug_key", "pt", "lit_score"), d.fresh_path(s, "briefs")
    tables.upsert_into(b.withColumn("origin", F.lit("old")), path, tables.SIGNAL_KEY)
    source = b.filter(F.col("lit_score") >= 0.5).select(
        "drug_key", "pt", (F.col("lit_score") / 2).alias("lit_score"), F.lit("new").alias("origin")
    )
    tables.upsert_into(source.filter("pt < 'nation_15'"), path, tables.SIGNAL_KEY)
    tables.upsert_into(source, path, tables.SIGNAL_KEY)
    return s.read.schema(source.schema).parquet(path).select(source.columns)  # without the bucket


@query("upsert_name_map", """SELECT left(prod_ai, 8) AS prod_ai, left(canonical_name, 8) AS canonical_name, rxcui
    FROM raw_map WHERE rxcui NOT LIKE '%5' UNION ALL SELECT left(prod_ai, 8), 'old', 'old' FROM raw_map WHERE rxcui LIKE '%5'""")
def _(s, p):
    """Stored names, of which most are replaced by fresh ones and the rest stays as it was."""
    fresh = tables.clip_names(d.raw_name_map(s, p), 8)
    target = fresh.select("prod_ai", F.lit("old").alias("canonical_name"), F.lit("old").alias("rxcui"))
    source = fresh.where(~F.col("rxcui").endswith("5"))
    older = source.withColumn("rxcui", F.lit("A"))  # a second row of each key, lower in order
    return tables.upsert(target, source.unionByName(older), ["prod_ai"], ["rxcui"])


@query("decision_log_valid", f"SELECT drug_key, pt, decision, {MOMENT.format('decided_at')} FROM decisions")
def _(s, p):
    good, _bad = tables.split_decisions(d.submitted_decisions(s, p))
    return good.select("drug_key", "pt", "decision", moment("decided_at"))


@query("decision_log_rejected", """SELECT decision, 'decision allowed' AS violations, count(*) AS n FROM submitted
    WHERE upper(decision) NOT IN ('APPROVE', 'REJECT') GROUP BY 1""")
def _(s, p):
    _good, bad = tables.split_decisions(d.submitted_decisions(s, p))
    return bad.groupBy("decision", joined("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("corpus_export", """SELECT group_key, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars
    FROM library GROUP BY 1""")
def _(s, p):
    path = d.fresh_path(s, "export")
    docs = d.library(s, p).withColumn("pmid", F.col("doc_id").cast("string"))
    tables.export_corpus(docs, path)
    back = s.read.schema("doc_id long, group_key string, text string, pmid string").json(path)
    sizes = back.groupBy("group_key").agg(F.sum(F.length("text")).alias("n_chars"))
    return tables.corpus_counts(back).join(sizes, "group_key")


@query("clean_copy", """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value,
    CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS event_type FROM events""")
def _(s, p):
    e = d.table(s, p, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", float("nan")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_type") == "click", "  ").otherwise(F.col("event_type")).alias("event_type"),
    )
    return tables.null_nan(e)


# --- report level ------------------------------------------------------------


@query("latest_case_version", "SELECT * FROM latest")
def _(s, p):
    return cases.latest_version(d.demo(s, p))


@query("outcome_flags", "SELECT * FROM flags")
def _(s, p):
    return cases.outcome_flags(d.outc(s, p))


@query("case_facts", f"SELECT primaryid, caseid, {DAY.format('fda_dt')}, source_quarter, death_flag, hosp_flag, lt_flag FROM facts")
def _(s, p):
    facts = cases.case_facts(cases.latest_version(d.demo(s, p)), cases.outcome_flags(d.outc(s, p)))
    return facts.withColumn("fda_dt", day("fda_dt"))


@query("suspect_drug_rows", "SELECT primaryid, role_cod, prod_ai, drugname FROM drug WHERE role_cod = 'PS'")
def _(s, p):
    return naming.suspect_rows(d.drug(s, p)).select("primaryid", "role_cod", "prod_ai", "drugname")


@query("combination_first_names", """SELECT split_part(prod_ai, '\\', 1) AS prod_ai, split_part(drugname, '\\', 1) AS drugname,
    upper(trim(split_part(prod_ai, '\\', 1))) AS join_key, count(*) AS n FROM drug GROUP BY 1, 2, 3""")
def _(s, p):
    drug = d.drug(s, p).withColumn("join_key", name_join_key(F.col("prod_ai")))
    cut = naming.first_names(drug)
    return cut.groupBy("prod_ai", "drugname", "join_key").agg(F.count(F.lit(1)).alias("n"))


@query("resolved_drug_names", "SELECT drug_key, rxcui, count(*) AS n FROM named GROUP BY 1, 2")
def _(s, p):
    named = naming.resolve_names(naming.suspect_rows(d.drug(s, p)), d.name_map(s, p))
    return named.groupBy("drug_key", "rxcui").agg(F.count(F.lit(1)).alias("n"))


@query("normalized_drugs", "SELECT primaryid, drug_key, rxcui FROM drugs")
def _(s, p):
    return naming.normalize(d.drug(s, p), d.name_map(s, p))


@query("deduplicated_reactions", "SELECT primaryid, pt FROM reactions")
def _(s, p):
    return pairs.dedup_reactions(d.reac(s, p))


@query("distinct_drug_names", "SELECT DISTINCT upper(trim(prod_ai)) AS prod_ai FROM drug WHERE prod_ai IS NOT NULL")
def _(s, p):
    return naming.distinct_names(d.drug(s, p))


@query("drug_reaction_pairs", f"""SELECT primaryid, caseid, drug_key, rxcui, pt, {DAY.format('fda_dt')},
    death_flag, hosp_flag, lt_flag, source_quarter FROM pairs""")
def _(s, p):
    return d.build_pairs(s, p).withColumn("fda_dt", day("fda_dt"))


@query("pairs_of_period", "SELECT primaryid, drug_key, pt FROM pairs WHERE source_quarter = '1999Q4'")
def _(s, p):
    return d.stored_pairs(s, p).filter(F.col("source_quarter") == "1999Q4").select("primaryid", "drug_key", "pt")


# --- disproportionality -------------------------------------------------------


@query("cell_counts", "SELECT * FROM cells")
def _(s, p):
    return dp.cell_counts(d.stored_pairs(s, p))


@query("cell_counts_distinct", """SELECT drug_key, pt, a, 2 * death_count AS death_count, 2 * hosp_count AS hosp_count,
    2 * lt_count AS lt_count FROM cells""")
def _(s, p):
    once = d.stored_pairs(s, p).select("primaryid", "drug_key", "pt", "death_flag", "hosp_flag", "lt_flag")
    return dp.cell_counts(once.unionAll(once), unique=False)


@query("drug_totals", "SELECT * FROM by_drug")
def _(s, p):
    return dp.drug_totals(d.stored_pairs(s, p))


@query("reaction_totals", "SELECT * FROM by_pt")
def _(s, p):
    return dp.reaction_totals(d.stored_pairs(s, p))


@query("report_total", "SELECT * FROM overall")
def _(s, p):
    return dp.report_total(d.stored_pairs(s, p))


@query("contingency_prr", "SELECT drug_key, pt, a, b, c, d, drug_total, reaction_total, prr FROM contingency")
def _(s, p):
    return dp.contingency(d.stored_pairs(s, p)).select(
        "drug_key", "pt", "a", "b", "c", "d", "drug_total", "reaction_total", "prr"
    )


@query("threshold_signals", "SELECT drug_key, pt, a, c, drug_total, prr FROM candidates")
def _(s, p):
    cells = dp.contingency(d.stored_pairs(s, p))
    return dp.threshold(cells, d.LIMITS, d.JUNK).select("drug_key", "pt", "a", "c", "drug_total", "prr")


@query("period_counts", "SELECT * FROM period_counts")
def _(s, p):
    return temporal.period_counts(d.stored_pairs(s, p))


@query("period_shares", """SELECT *, CAST(max_rows AS DOUBLE) / total_rows AS spike_share,
    CAST(late_rows AS DOUBLE) / total_rows AS late_share FROM shares""")
def _(s, p):
    return temporal.period_shares(d.stored_pairs(s, p), d.LATE)


def _candidates(s, p):
    return dp.threshold(dp.contingency(d.stored_pairs(s, p)), d.LIMITS, d.JUNK)


@query("spike_filter", f"""SELECT c.drug_key, c.pt, c.prr FROM candidates c JOIN shares h ON c.drug_key = h.drug_key AND c.pt = h.pt
    WHERE CAST(max_rows AS DOUBLE) / total_rows <= {d.SPIKE_MAX}""")
def _(s, p):
    kept = temporal.filter_periods(_candidates(s, p), d.stored_pairs(s, p), d.SPIKE_MAX, d.LATE, None)
    return kept.select("drug_key", "pt", "prr")


@query("surge_filter", f"""SELECT c.drug_key, c.pt, c.prr FROM candidates c JOIN shares h ON c.drug_key = h.drug_key AND c.pt = h.pt
    WHERE CAST(late_rows AS DOUBLE) / total_rows <= {d.LATE_MAX}""")
def _(s, p):
    kept = temporal.filter_periods(_candidates(s, p), d.stored_pairs(s, p), None, d.LATE, d.LATE_MAX)
    return kept.select("drug_key", "pt", "prr")


@query("single_period_skips_spike", """SELECT drug_key, pt, count(*) AS n FROM pairs WHERE source_quarter = '1999Q4'
    GROUP BY 1, 2""")
def _(s, p):
    one = d.stored_pairs(s, p).filter(F.col("source_quarter") == "1999Q4")
    cells = one.groupBy("drug_key", "pt").agg(F.count(F.lit(1)).alias("n"))
    return temporal.filter_periods(cells, one, 0.1, d.LATE, 0.1)


@query("flagged_signals", "SELECT * FROM signals")
def _(s, p):
    return d.flagged(s, p)


@query("flagged_from_reports", f"""SELECT drug_key, pt, prr, a AS drug_reaction_count, c AS other_reaction_count, drug_total, death_count
    FROM signals_with_totals""")
def _(s, p):
    return flagging.flag_reports(
        d.demo(s, p), d.drug(s, p), d.reac(s, p), d.outc(s, p), d.name_map(s, p), d.LIMITS, d.JUNK,
        spike_max=d.SPIKE_MAX, late_periods=d.LATE, late_max=d.LATE_MAX,
    ).select("drug_key", "pt", "prr", "drug_reaction_count", "other_reaction_count", "drug_total", "death_count")


@query("contingency_from_partials", "SELECT drug_key, pt, a, b, c, d, drug_total, reaction_total, prr FROM contingency")
def _(s, p):
    partials = storage.stored(dp.partial_cells(d.marked_pairs(s, p)), "cells")
    return dp.contingency_of(partials).select("drug_key", "pt", "a", "b", "c", "d", "drug_total", "reaction_total", "prr")


def _kept_signals(s, p):
    """Reports that arrive period by period, so that most cases are superseded once on the way."""
    state = incremental.SignalState(s, d.fresh_path(s, "state"))
    names = storage.stored(d.name_map(s, p), "names")
    folder, arrivals = _arrivals(s, p)
    for arrival in arrivals:
        entities = (s.read.parquet(f"{folder}/{name}").where(F.col("arrival") == arrival) for name in ("demo", "drug", "reac", "outc"))
        state.add(arrival, *(rows.drop("arrival") for rows in entities), names)
    return state


def _arrivals(s, p):
    """The four entities in folders of the periods in which their reports arrive: each row is sent to its period once."""
    folder, own = d.fresh_path(s, "arrivals"), F.substring("source_quarter", 1, 4)
    arrival = F.when(own.isin("1992", "1993", "1994"), "1992").when(own.isin("1995", "1996"), "1995").when(own.isin("1997", "1998"), "1997")
    demo = d.demo(s, p).withColumn("arrival", arrival.otherwise("rest"))
    demo.write.partitionBy("arrival").parquet(f"{folder}/demo")
    parts = {"drug": d.drug(s, p), "reac": d.reac(s, p), "outc": d.outc(s, p)}
    tasks = joins.task_count(demo, *parts.values())
    known = joins.dealt(demo.select("primaryid", "arrival"), tasks)
    for name, rows in parts.items():
        joins.dealt(rows, tasks).join(known, "primaryid").write.partitionBy("arrival").parquet(f"{folder}/{name}")
    return folder, ("1992", "1995", "1997", "rest")


@query("flagged_by_differences", """SELECT drug_key, pt, prr, a AS drug_reaction_count, c AS other_reaction_count, drug_total, death_count
    FROM signals_with_totals""")
def _(s, p):
    return _kept_signals(s, p).signals(d.LIMITS, d.JUNK, d.SPIKE_MAX, d.LATE, d.LATE_MAX).select(
        "drug_key", "pt", "prr", "drug_reaction_count", "other_reaction_count", "drug_total", "death_count"
    )


@query("stat_scores", """SELECT drug_key, pt, stat_score, CASE WHEN stat_score >= 0.7 THEN 'high'
    WHEN stat_score >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM (
      SELECT drug_key, pt, """ + STAT + " AS stat_score FROM contingency)")
def _(s, p):
    scored = dp.signal_table(dp.contingency(d.stored_pairs(s, p)))
    return scored.select("drug_key", "pt", "stat_score", scores.stat_band(F.col("stat_score")).alias("band"))


@query("production_thresholds", """SELECT drug_key, pt, prr FROM contingency
    WHERE prr >= 2.0 AND a >= 50 AND c >= 200 AND drug_total >= 1000""")
def _(s, p):
    cells = dp.contingency(d.stored_pairs(s, p))
    return dp.threshold(cells, dp.Thresholds.production(), dp.JUNK_TERMS).select("drug_key", "pt", "prr")


@query("wide_thresholds", """SELECT drug_key, pt, prr FROM contingency
    WHERE prr >= 1.5 AND a >= 4 AND c >= 50 AND drug_total >= 40""")
def _(s, p):
    cells = dp.contingency(d.stored_pairs(s, p))
    limits = dp.Thresholds(prr=1.5, cases=4, other_cases=50, drug_cases=40)
    return dp.threshold(cells, limits, dp.JUNK_TERMS).select("drug_key", "pt", "prr")


# --- review ---------------------------------------------------------------------


@query("signal_feed", f"SELECT {FEED_SQL} FROM feed")
def _(s, p):
    return feed(s, p)


ORDER_SQL = f"{tier_rank('priority')}, prr DESC, drug_key, pt"


@query("feed_page", f"SELECT {FEED_SQL} FROM feed ORDER BY {ORDER_SQL} LIMIT 20 OFFSET 10")
def _(s, p):
    return review.feed_page(feed(s, p), limit=20, offset=10)


@query("feed_of_tier", f"SELECT {FEED_SQL} FROM feed WHERE priority = 'P3'")
def _(s, p):
    return review.order_feed(review.filter_feed(feed(s, p), priority="P3"))


@query("feed_search", f"SELECT {FEED_SQL} FROM feed WHERE drug_key ILIKE '%ND#1%' OR pt ILIKE '%ND#1%'")
def _(s, p):
    return review.order_feed(review.filter_feed(feed(s, p), search="ND#1"))


@query("feed_search_by_trigrams", "SELECT drug_key, pt FROM signals WHERE drug_key ILIKE '%ND#1%' OR pt ILIKE '%ND#1%'")
def _(s, p):
    path = d.fresh_path(s, "grams")
    substring_index.store(d.stored_signals(s, p), path)
    return substring_index.search(s, path, "ND#1")


@query("feed_seek_pages", f"SELECT {FEED_SQL} FROM feed ORDER BY {ORDER_SQL} LIMIT 20 OFFSET 20")
def _(s, p):
    """The second page, from where the first one ended."""
    store = feed_store.FeedStore.write(feed(s, p), d.fresh_path(s, "feed"))
    first = store.page(20).collect()
    return (store.page(20, store.position(first[-1])) if first else store.page(0)).select(*FEED_COLUMNS)


for _by, _sql in {
    "priority": f"{tier_rank('coalesce(upper(priority), ' + chr(39) + 'P4' + chr(39) + ')', 4)}",
    "prr": "coalesce(prr, 0) DESC",
    "cases": "coalesce(drug_reaction_count, 0) DESC",
    "deaths": "coalesce(death_count, 0) DESC",
}.items():

    @query(f"feed_by_{_by}", f"SELECT {FEED_SQL} FROM feed ORDER BY {_sql}, drug_key, pt LIMIT 15")
    def _(s, p, by=_by):
        return review.feed_page(feed(s, p), limit=15, by=by)


BRIEF_DETAIL = (
    "drug_key", "pt", "prr", "drug_reaction_count", "drug_no_reaction_count", "other_reaction_count",
    "other_no_reaction_count", "stat_score", "brief_id", "lit_score", "priority", "recommended_action",
)


@query("brief_detail", f"""SELECT s.drug_key, s.pt, s.prr, drug_reaction_count, drug_no_reaction_count,
    other_reaction_count, other_no_reaction_count, s.stat_score, brief_id, lit_score, priority, recommended_action,
    {LIST.format('pmids_cited')}, {MOMENT.format('generated_at')}
    FROM signals s LEFT JOIN briefs b ON s.drug_key = b.drug_key AND s.pt = b.pt
    WHERE s.drug_key = (SELECT max(drug_key) FROM signals) AND s.pt = (SELECT max(pt) FROM signals
      WHERE drug_key = (SELECT max(drug_key) FROM signals))""")
def _(s, p):
    signals = d.stored_signals(s, p)
    last = signals.agg(F.max(F.struct("drug_key", "pt")).alias("k")).select("k.*").first()
    found = review.brief_detail(signals, d.stored_briefs(s, p), last.drug_key, last.pt)
    return found.select(*BRIEF_DETAIL, joined("pmids_cited"), moment("generated_at"))


@query("signals_of_drugs", """SELECT drug_key, pt, prr, death_count, hosp_count, lt_count FROM signals
    WHERE drug_key IN (SELECT drug_key FROM golden WHERE comm_date IS NULL)""")
def _(s, p):
    listed = d.golden(s, p).filter(F.col("comm_date").isNull()).select("drug_key")
    return review.in_list(d.stored_signals(s, p), listed).select(
        "drug_key", "pt", "prr", "death_count", "hosp_count", "lt_count"
    )


@query("signals_of_pairs", """SELECT m.drug_key, m.pt, m.prr FROM meets m JOIN golden g
    ON m.drug_key = g.drug_key AND m.pt = g.pt""")
def _(s, p):
    strong = review.meets(d.stored_signals(s, p), 1.25, 32)
    return review.in_list(strong, d.golden(s, p).select("drug_key", "pt")).select("drug_key", "pt", "prr")


@query("investigated_signals", f"SELECT {FEED_SQL} FROM feed WHERE priority IS NOT NULL")
def _(s, p):
    return review.investigated(feed(s, p))


@query("uninvestigated_signals", f"""SELECT {FEED_SQL} FROM feed f WHERE priority IS NULL AND NOT EXISTS
    (SELECT 1 FROM golden g WHERE g.drug_key = f.drug_key AND g.pt = f.pt)""")
def _(s, p):
    return review.uninvestigated(feed(s, p), d.golden(s, p))


@query("latest_decision", "SELECT drug_key, pt, decision FROM latest_decision")
def _(s, p):
    return review.latest_decision(d.decisions(s, p))


@query("undecided_signals", """SELECT drug_key, pt, prr FROM signals s WHERE NOT EXISTS
    (SELECT 1 FROM decisions h WHERE h.drug_key = s.drug_key AND h.pt = s.pt)""")
def _(s, p):
    return review.undecided(d.stored_signals(s, p), d.decisions(s, p)).select("drug_key", "pt", "prr")


@query("review_queue", f"""SELECT brief_id, r.drug_key, r.pt, priority, r.stat_score, lit_score, recommended_action,
    brief_text, s.prr, s.drug_reaction_count AS case_count, {MOMENT.format('generated_at')}
    FROM ready r JOIN signals s ON r.drug_key = s.drug_key AND r.pt = s.pt""")
def _(s, p):
    q = review.queue(d.stored_signals(s, p), d.stored_briefs(s, p), d.decisions(s, p))
    return q.select(
        "brief_id", "drug_key", "pt", "priority", "stat_score", "lit_score", "recommended_action",
        "brief_text", "prr", "case_count", moment("generated_at"),
    )


@query("queue_search_in_tier", """SELECT drug_key, pt, priority FROM ready
    WHERE (contains(drug_key, 'n_1') OR contains(pt, 'n_1')) AND priority = 'P4'""")
def _(s, p):
    q = review.queue(d.stored_signals(s, p), d.stored_briefs(s, p), d.decisions(s, p))
    return review.filter_feed(q, priority="P4", search="N_1").select("drug_key", "pt", "priority")


@query("decision_history", f"SELECT drug_key, pt, decision, reviewer_note, {MOMENT.format('decided_at')} FROM decisions")
def _(s, p):
    return review.history(d.decisions(s, p)).withColumn("decided_at", moment("decided_at"))


@query("feed_counts", """SELECT count(*) AS total, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (priority = 'P2') AS p2,
    count(*) FILTER (priority = 'P3') AS p3, count(*) FILTER (priority = 'P4') AS p4,
    count(*) FILTER (priority IS NULL) AS uninvestigated FROM feed""")
def _(s, p):
    return review.feed_counts(d.stored_signals(s, p), d.stored_briefs(s, p))


@query("pending_briefs", "SELECT count(*) AS pending_briefs FROM ready")
def _(s, p):
    return review.pending_briefs(d.stored_briefs(s, p), d.decisions(s, p))


@query("signal_gauges", """SELECT count(*) AS signals_flagged, count(*) FILTER (NOT EXISTS
    (SELECT 1 FROM decisions h WHERE h.drug_key = s.drug_key AND h.pt = s.pt)) AS pending_signals FROM signals s""")
def _(s, p):
    return review.signal_gauges(d.stored_signals(s, p), d.decisions(s, p))


@query("pending_per_tier", """SELECT count(*) AS total, count(*) FILTER (priority = 'P1') AS p1,
    count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3,
    count(*) FILTER (priority = 'P4') AS p4 FROM ready""")
def _(s, p):
    return review.pending_per_tier(review.queue(d.stored_signals(s, p), d.stored_briefs(s, p), d.decisions(s, p)))


TABLE_COUNTS = """SELECT (SELECT count(*) FROM signals) AS signals_flagged,
    (SELECT count(*) FROM briefs WHERE NOT generation_error) AS safety_briefs,
    (SELECT count(*) FROM decisions) AS hitl_decisions"""


@query("table_counts", TABLE_COUNTS)
def _(s, p):
    return review.table_counts(d.stored_signals(s, p), d.stored_briefs(s, p), d.decisions(s, p))


@query("tier_distribution", "SELECT priority, count(*) AS n FROM briefs WHERE priority IS NOT NULL GROUP BY 1")
def _(s, p):
    return review.tier_distribution(d.stored_briefs(s, p))


@query("decision_breakdown", "SELECT decision, count(*) AS n FROM decisions GROUP BY 1")
def _(s, p):
    return review.decision_breakdown(d.decisions(s, p))


@query("run_metrics", f"""SELECT *, {rnd('(tokens_in * CAST(0.15 AS DOUBLE) + tokens_out * CAST(0.6 AS DOUBLE)) / 1000000', 4)} AS estimated_cost FROM (
    SELECT count(*) AS total_runs, coalesce(CAST(sum(input_tokens) AS BIGINT), 0) AS tokens_in,
      coalesce(CAST(sum(output_tokens) AS BIGINT), 0) AS tokens_out, {rnd('coalesce(avg(lit_score), 0)', 4)} AS avg_lit_score, count(*) FILTER (lit_score = 0) AS zero_lit_runs,
      count(*) FILTER (generation_error) AS generation_errors FROM briefs)""")
def _(s, p):
    return review.run_metrics(d.stored_briefs(s, p))


@query("coverage_percentages", f"""SELECT {pct('safety_briefs', 'signals_flagged')} AS brief_coverage,
    {pct('hitl_decisions', 'safety_briefs')} AS review_coverage,
    {pct('p1', 'p1 + p2 + p3 + p4')} AS p1_share, {pct('p2', 'p1 + p2 + p3 + p4')} AS p2_share,
    {pct('p3', 'p1 + p2 + p3 + p4')} AS p3_share, {pct('p4', 'p1 + p2 + p3 + p4')} AS p4_share,
    {pct('approved', 'approved + rejected')} AS approve_share, {pct('rejected', 'approved + rejected')} AS reject_share,
    {pct('pending', 'pending + hitl_decisions')} AS pending_share,
    {pct('hitl_decisions', 'pending + hitl_decisions')} AS decided_share
    FROM ({TABLE_COUNTS}, (SELECT count(*) FROM briefs WHERE priority = 'P1') AS p1,
      (SELECT count(*) FROM briefs WHERE priority = 'P2') AS p2, (SELECT count(*) FROM briefs WHERE priority = 'P3') AS p3,
      (SELECT count(*) FROM briefs WHERE priority = 'P4') AS p4,
      (SELECT count(*) FROM decisions WHERE decision = 'APPROVE') AS approved,
      (SELECT count(*) FROM decisions WHERE decision = 'REJECT') AS rejected, (SELECT count(*) FROM ready) AS pending)""")
def _(s, p):
    signals, briefs, decisions = d.stored_signals(s, p), d.stored_briefs(s, p), d.decisions(s, p)
    return review.coverage(
        review.table_counts(signals, briefs, decisions), review.tier_distribution(briefs),
        review.decision_breakdown(decisions), review.pending_briefs(briefs, decisions),
    )


@query("reactions_per_drug", """SELECT drug_key, array_to_string(list_sort(list(DISTINCT pt)), ' | ') AS reactions FROM signals GROUP BY 1""")
def _(s, p):
    return review.reactions_per_drug(d.stored_signals(s, p)).select("drug_key", joined("reactions"))


@query("brief_json_columns", """SELECT drug_key, pt, CASE WHEN key_findings = 'not json' THEN ''
    ELSE pt || ' | n=' || CAST(a AS VARCHAR) END AS key_findings, len(pmids_cited) AS n_cited FROM briefs""")
def _(s, p):
    return review.clean_briefs(d.stored_briefs(s, p)).select(
        "drug_key", "pt", joined("key_findings"), F.size("pmids_cited").cast("long").alias("n_cited")
    )


@query("score_bands", """SELECT drug_key, pt, CASE WHEN stat_score >= 0.7 THEN 'high' WHEN stat_score >= 0.5 THEN 'medium' ELSE 'low' END AS stat_band,
    CASE WHEN lit_score >= 0.5 THEN 'high' WHEN lit_score >= 0.3 THEN 'medium' ELSE 'low' END AS lit_band FROM briefs""")
def _(s, p):
    return d.stored_briefs(s, p).select(
        "drug_key", "pt", scores.stat_band(F.col("stat_score")).alias("stat_band"),
        scores.lit_band(F.col("lit_score")).alias("lit_band"),
    )


# --- retrieval --------------------------------------------------------------------


@query("text_tokens", f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, len(list_distinct({sql_tokens('text')})) AS n_terms FROM documents")
def _(s, p):
    toks = tokens(F.col("text"))
    return d.library(s, p).select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_terms")
    )


@query("term_postings", "SELECT group_key, doc_id, term, tf FROM bm25_library_postings")
def _(s, p):
    return retrieval.postings(d.library(s, p)).drop("n_tokens")


@query("term_weights", "SELECT term, df, round(idf, 6) AS idf FROM bm25_library_idf")
def _(s, p):
    return retrieval.term_weights(d.library(s, p)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("corpus_statistics", "SELECT n_docs, round(mean_tokens, 6) AS mean_tokens FROM bm25_library_stats")
def _(s, p):
    return retrieval.corpus_stats(d.library(s, p)).select("n_docs", F.round("mean_tokens", 6).alias("mean_tokens"))


def ranked_sql(scored: str, floor: float, k: int) -> str:
    return f"""SELECT signal_id, query_no, doc_id, rank, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY signal_id, query_no ORDER BY round(score, 9) DESC, doc_id) AS rank
        FROM {scored} WHERE score >= {floor}) WHERE rank <= {k}"""


def ranked(df):
    return df.select(
        "signal_id", "query_no", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")
    )


@query("bm25_topk", ranked_sql("bm25_library_scored", 0.1, 10))
def _(s, p):
    return ranked(retrieval.bm25_topk(d.library_queries(s, p), d.library(s, p)))


@query("bm25_topk_stored_index", ranked_sql("bm25_library_scored", 0.1, 10))
def _(s, p):
    root = d.fresh_path(s, "index")
    retrieval.store_index(retrieval.bm25_index(d.library(s, p)), root)
    return ranked(retrieval.bm25_topk(d.library_queries(s, p), retrieval.load_index(s, root)))


def _grown_library(s, p):
    """The library as three segments, added one after the other; the last two are united afterwards."""
    docs = d.library(s, p)
    part = [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == i) for i in range(3)]
    index = text_index.TextIndex(s, (text_index.write_segment(part[0], d.fresh_path(s, "segment"), block_docs=128),))
    for more in part[1:]:
        index = index.add(more, d.fresh_path(s, "segment"), block_docs=128)
    return index


@query("bm25_topk_segments", ranked_sql("bm25_library_scored", 0.1, 10))
def _(s, p):
    return ranked(retrieval.bm25_topk(d.library_queries(s, p), _grown_library(s, p)))


@query("bm25_topk_merged_segments", ranked_sql("bm25_library_scored", 0.1, 10))
def _(s, p):
    index = _grown_library(s, p)
    return ranked(retrieval.bm25_topk(d.library_queries(s, p), index.merge(index.segments[1:], d.fresh_path(s, "segment"))))


@query("segment_frequencies", "SELECT term, CAST(sum(df) AS BIGINT) AS df FROM bm25_library_idf GROUP BY term")
def _(s, p):
    return _grown_library(s, p).frequencies()


VECTOR_SCORED = """(SELECT 'v' || CAST(q.vec_id AS VARCHAR) AS signal_id, 1 AS query_no, e.vec_id AS doc_id,
    list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
      / (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
       * sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) AS score
    FROM embeddings q JOIN embeddings e ON q.label = e.label)"""


@query("dense_topk", ranked_sql(VECTOR_SCORED, 0.2, 10))
def _(s, p):
    return ranked(retrieval.dense_topk(d.vector_queries(s, p), d.vectors(s, p), min_similarity=0.2))


@query("dense_topk_cells", ranked_sql(VECTOR_SCORED, 0.2, 10))
def _(s, p):
    """The vector index with all of its cells, which is the exact search."""
    index = vector_index.VectorIndex.build(d.vectors(s, p), d.fresh_path(s, "vectors"))
    return ranked(retrieval.dense_topk(d.vector_queries(s, p), index, min_similarity=0.2, probes=None))


NEXT_COSINE = rnd("list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y)))", 4)


@query("neighbour_cosine", f"""SELECT vec_id, {NEXT_COSINE} AS similarity, round(1.0 - {NEXT_COSINE}, 6) AS distance FROM (
    SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS x, CAST(f.embedding AS DOUBLE[]) AS y
    FROM embeddings e JOIN embeddings f ON e.vec_id + 1 = f.vec_id)""")
def _(s, p):
    e = d.table(s, p, "embeddings").select("vec_id", "embedding")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    similarity = half_even(cosine(F.col("embedding"), F.col("next")), 4)
    return e.join(following, "vec_id").select(
        "vec_id", similarity.alias("similarity"), F.round(F.lit(1.0) - similarity, 6).alias("distance")
    )


@query("hybrid_hits", """SELECT signal_id, query_no, retriever, rank, doc_id, similarity, round(distance, 6) AS distance FROM hits""")
def _(s, p):
    hits = retrieval.search(d.literature_queries(s, p), d.corpus(s, p), min_similarity=0.2)
    return hits.select(
        "signal_id", "query_no", "retriever", F.col("rank").cast("long").alias("rank"), "doc_id", "similarity",
        F.round("distance", 6).alias("distance"),
    )


@query("fused_ranking", "SELECT signal_id, doc_id, fused_rank, round(rrf_score, 9) AS rrf_score, similarity, retriever FROM fused")
def _(s, p):
    return retrieval.fuse(d.stored_hits(s, p)).select(
        "signal_id", "doc_id", F.col("fused_rank").cast("long").alias("fused_rank"),
        F.round("rrf_score", 9).alias("rrf_score"), "similarity", "retriever",
    )


def _added_corpus(s, p):
    """Half of the corpus is loaded; the other half is added as records. The corpus by text ids, and its index."""
    whole = d.corpus(s, p).withColumn("pmid", F.col("doc_id").cast("string"))
    loaded = storage.stored(
        whole.where("doc_id % 2 = 0").select("group_key", "pmid", corpus.doc_key(F.col("group_key"), F.col("pmid")).alias("doc_id"), "text", "embedding"),
        "loaded",
    )
    records = whole.select(
        "group_key", "pmid", F.concat(F.lit("Title "), "pmid").alias("title"), F.array("text").alias("abstract_parts"), F.lit("2023").alias("year")
    )
    fresh = corpus.new_documents(records, loaded.select("group_key", "pmid")).join(whole.select("pmid", "embedding"), "pmid")
    added = storage.stored(fresh.withColumnRenamed("doc_key", "doc_id").select(loaded.columns), "additions")
    index = text_index.TextIndex(s, (text_index.write_segment(loaded, d.fresh_path(s, "segment")),)).add(added, d.fresh_path(s, "segment"))
    return loaded.unionByName(added), index


@query("searched_additions", "SELECT signal_id, doc_id, fused_rank, round(rrf_score, 9) AS rrf_score, similarity, retriever FROM added_fused")
def _(s, p):
    docs, index = _added_corpus(s, p)
    hits = retrieval.search(d.literature_queries(s, p), docs, min_similarity=0.2, index=index)
    return retrieval.fuse(hits).select(
        "signal_id", "doc_id", F.col("fused_rank").cast("long").alias("fused_rank"),
        F.round("rrf_score", 9).alias("rrf_score"), "similarity", "retriever",
    )


LIT_SQL = f"""SELECT i.signal_id, coalesce(n, 0) AS n_hits, CASE WHEN coalesce(n, 0) = 0 THEN 0.0
      ELSE {rnd('coalesce(m, 0.65) * CAST(0.7 AS DOUBLE) + least(n / 5.0, 1.0) * CAST(0.3 AS DOUBLE)', 4)} END AS lit_score
    FROM item_signals i LEFT JOIN (SELECT signal_id, count(*) AS n, avg(CASE WHEN retriever = 'hnsw' THEN similarity END) AS m
      FROM fused WHERE fused_rank <= 5 GROUP BY 1) h ON i.signal_id = h.signal_id"""


@query("literature_scores", LIT_SQL)
def _(s, p):
    return retrieval.lit_scores(d.item_signals(s, p), retrieval.top_hits(retrieval.fuse(d.stored_hits(s, p))))


@query("evidence_report", f"""SELECT i.signal_id, coalesce(h, 0) AS hnsw_count, coalesce(b, 0) AS bm25_count,
      coalesce({rnd('m', 4)}, 0.0) AS avg_similarity, coalesce(n, 0) AS total_retrieved
    FROM item_signals i LEFT JOIN (SELECT signal_id, count(*) FILTER (fused_rank <= 10 AND retriever = 'hnsw') AS h,
      count(*) FILTER (fused_rank <= 10 AND retriever = 'bm25') AS b,
      avg(CASE WHEN fused_rank <= 10 THEN similarity END) AS m, count(*) AS n FROM fused GROUP BY 1) f
    ON i.signal_id = f.signal_id""")
def _(s, p):
    return retrieval.evidence_summary(d.item_signals(s, p), retrieval.fuse(d.stored_hits(s, p)))


@query("evidence_blocks", f"""SELECT i.signal_id, coalesce(b, 'No abstracts retrieved above similarity threshold.') AS evidence
    FROM item_signals i LEFT JOIN (SELECT signal_id, string_agg('[' || CAST(fused_rank AS VARCHAR) || '] PMID:' || CAST(f.doc_id AS VARCHAR)
      || ' | similarity=' || {fix('similarity', 3)} || chr(10) || text, chr(10) || chr(10) ORDER BY fused_rank) AS b
      FROM fused f JOIN documents d ON f.doc_id = d.doc_id WHERE fused_rank <= 5 GROUP BY 1) x ON i.signal_id = x.signal_id""")
def _(s, p):
    top = retrieval.top_hits(retrieval.fuse(d.stored_hits(s, p)))
    return retrieval.evidence_block(d.item_signals(s, p), top, d.corpus(s, p)).select("signal_id", "evidence")


@query("evidence_of_known_signals", """SELECT e.drug_key, e.pt, count(*) AS n FROM evidence e JOIN signals s
    ON e.drug_key = s.drug_key AND e.pt = s.pt WHERE s.prr >= 1.3 GROUP BY 1, 2""")
def _(s, p):
    known = d.stored_signals(s, p).filter(F.col("prr") >= 1.3)
    return review.in_list(d.evidence(s, p).withColumn("prr", F.lit(0.0)).withColumns(
        {c: F.lit(0) for c in ("death_count", "hosp_count", "lt_count")}
    ), known.select("drug_key", "pt")).groupBy("drug_key", "pt").agg(F.count(F.lit(1)).alias("n"))


@query("retrieval_spot_check", """SELECT signal_id, query_no, count(*) FILTER (score >= 0.2) AS n_above, count(*) AS n_found,
    count(*) FILTER (score >= 0.2) >= 3 AS ok FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, query_no
      ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dense_scored) WHERE rank <= 5 GROUP BY 1, 2""")
def _(s, p):
    return retrieval.spot_check(d.literature_queries(s, p), d.corpus(s, p), min_similarity=0.2)


@query("group_sufficiency", """SELECT group_key, count(*) AS n_docs, count(*) >= 50 AS sufficient, count(*) >= 150 AS skip_loading
    FROM library GROUP BY 1""")
def _(s, p):
    return corpus.group_sizes(d.library(s, p))


def _records(s, p):
    """Documents as fetched records: half of them already loaded, some without abstract."""
    docs = d.table(s, p, "documents")
    return docs.select(
        F.col("source").alias("group_key"), F.col("doc_id").cast("string").alias("pmid"),
        F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("lang") == "de", F.array(F.lit(" "))).otherwise(F.array("lang", F.lit(None), "text")).alias("abstract_parts"),
        F.lit("2023").alias("year"), "doc_id", "n_chars",
    )


@query("corpus_additions", """SELECT source AS group_key, CAST(doc_id AS VARCHAR) AS pmid, source || '_' || CAST(doc_id AS VARCHAR) AS doc_key,
    'Title ' || CAST(doc_id AS VARCHAR) || ' ' || lang || ' ' || text AS text, CAST(doc_id AS VARCHAR) AS pmid_again
    FROM documents WHERE lang <> 'de' AND n_chars < 3000""")
def _(s, p):
    records = _records(s, p)
    loaded = records.filter(F.col("n_chars") >= 3000)
    added = corpus.new_documents(records.unionByName(records).drop("doc_id", "n_chars"), loaded)
    return added.select("group_key", "pmid", "doc_key", "text", corpus.pmid_of(F.col("doc_key")).alias("pmid_again"))


@query("first_position_ids", """SELECT source AS group_key, lang AS pmid, min(doc_id) AS position FROM documents GROUP BY 1, 2""")
def _(s, p):
    found = d.table(s, p, "documents").select(
        F.col("source").alias("group_key"), F.col("lang").alias("pmid"), F.col("doc_id").alias("position")
    )
    return corpus.dedup_ids(found)


# --- search queries and investigation ------------------------------------------


TEMPLATES = [
    f"drug_key || ' ' || pt || ' {e}'" for e in search_queries.TEMPLATE_ENDINGS
]


@query("template_queries", " UNION ALL ".join(
    f"SELECT drug_key, pt, {n} AS query_no, {t} AS text FROM signals" for n, t in enumerate(TEMPLATES, start=1)))
def _(s, p):
    prepared = investigation.prepare(d.stored_signals(s, p))
    return search_queries.query_rows(prepared, ["drug_key", "pt"])


def _replies(s, p):
    """Replies of every kind: fenced valid, plain valid, too short, repeated, not JSON."""
    c = F.col("drug_reaction_count") % 5
    q = search_queries.template_queries(F.concat(F.lit(" x "), F.col("drug_key")), F.col("pt"))
    good = F.to_json(q)
    return d.stored_signals(s, p).select(
        "drug_key", "pt",
        F.when(c == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(c == 1, good)
        .when(c == 2, F.to_json(search_queries.template_queries(F.col("drug_key"), F.col("pt"), search_queries.SHORT_ENDINGS)))
        .when(c == 3, F.to_json(F.array(q[0], q[0], q[1])))
        .otherwise("no list here").alias("reply"),
    )


@query("chosen_queries", f"""SELECT drug_key, pt, drug_reaction_count % 5 IN (0, 1) AS generated,
    CASE WHEN drug_reaction_count % 5 IN (0, 1) THEN 'x ' ELSE '' END || {TEMPLATES[0]} AS q1,
    CASE WHEN drug_reaction_count % 5 IN (0, 1) THEN 'x ' ELSE '' END || {TEMPLATES[2]} AS q3 FROM signals""")
def _(s, p):
    return search_queries.choose_queries(_replies(s, p)).select(
        "drug_key", "pt", "generated", F.col("search_queries")[0].alias("q1"), F.col("search_queries")[2].alias("q3")
    )


@query("query_term_coverage", """SELECT generator, count(*) AS n_signals, count(*) FILTER (hit) AS n_with_terms,
    count(*) FILTER (hit) >= count(*) * 0.7 AS ok FROM (
      SELECT generator, contains(lower(drug_key || ' ' || pt || ending), lower(term)) AS hit FROM (
        SELECT *, CASE drug_reaction_count % 3 WHEN 0 THEN upper(pt) WHEN 1 THEN 'Pharmacology' ELSE drug_key || other_reaction_count END AS term
        FROM signals) CROSS JOIN (VALUES ('template', ' mechanism pharmacology adverse reaction'), ('naive', ' adverse')) v(generator, ending))
    GROUP BY 1""")
def _(s, p):
    """One expected term a signal: its reaction, a word of one generator's queries, or one that no query has."""
    kind = F.col("drug_reaction_count") % 3
    none = F.concat("drug_key", F.col("other_reaction_count").cast("string"))
    expected = F.array(F.when(kind == 0, F.upper("pt")).when(kind == 1, F.lit("Pharmacology")).otherwise(none))
    def rows(name, endings):
        return d.stored_signals(s, p).select(
            F.lit(name).alias("generator"),
            search_queries.template_queries(F.col("drug_key"), F.col("pt"), endings).alias("queries"),
            expected.alias("expected_terms"),
        )
    return search_queries.term_coverage(
        rows("template", search_queries.TEMPLATE_ENDINGS).unionByName(rows("naive", search_queries.SHORT_ENDINGS))
    )


@query("retrieval_floor", """SELECT i.signal_id, count(h.doc_id) > 0 AS ok FROM item_signals i LEFT JOIN hits h
    ON i.signal_id = h.signal_id AND h.retriever = 'hnsw' AND h.rank = 1 AND h.similarity >= 0.4 GROUP BY 1""")
def _(s, p):
    hits = d.stored_hits(s, p).filter((F.col("retriever") == "hnsw") & (F.col("similarity") >= 0.4))
    return search_queries.retrieval_floor(d.item_signals(s, p), hits)


@query("severity_texts", f"""SELECT drug_key, pt, coalesce(nullif({outcome_parts('life-threatening')}, ''), 'no serious outcomes reported') AS severity,
    'Serious outcomes: ' || coalesce(nullif({outcome_parts('life-threatening events')}, ''), 'none reported') AS outcome_line
    FROM contingency""")
def _(s, p):
    cells = dp.contingency(d.stored_pairs(s, p))
    counts = [F.col(c) for c in ("death_count", "lt_count", "hosp_count")]
    return cells.select(
        "drug_key", "pt", scores.outcome_text(*counts).alias("severity"), scores.outcome_line(*counts).alias("outcome_line")
    )


HINT = f"""CASE WHEN death_count > 0 AND prr * 3 > 10 THEN '⚠ WITHDRAW criteria may be met: ' || CAST(death_count AS VARCHAR)
      || ' deaths reported with PRR ' || {fix('prr * 3', 2)} || ' > 10'
    WHEN death_count > 0 AND prr * 3 > 2 THEN '⚠ RESTRICT criteria may be met: ' || CAST(death_count AS VARCHAR)
      || ' deaths reported with PRR ' || {fix('prr * 3', 2)} || ' > 2 — consider whether use should be limited to specific populations'
    WHEN lt_count > 0 AND prr * 3 > 2 THEN '⚠ RESTRICT criteria may be met: ' || CAST(lt_count AS VARCHAR)
      || ' life-threatening events with PRR ' || {fix('prr * 3', 2)}
    WHEN death_count = 0 AND lt_count = 0 AND hosp_count = 0 AND prr * 3 < 5 THEN 'ℹ No serious outcomes reported and PRR below 5 — '
      || 'consider whether MONITOR is appropriate if reaction is mild and self-limiting' ELSE '' END"""


@query("action_hints", f"SELECT drug_key, pt, {HINT} AS hint FROM contingency")
def _(s, p):
    hint = scores.action_hint(F.col("death_count"), F.col("lt_count"), F.col("hosp_count"), F.col("prr") * 3)
    return dp.contingency(d.stored_pairs(s, p)).select("drug_key", "pt", hint.alias("hint"))


@query("priority_tiers", f"SELECT drug_key, pt, {priority('stat_score', '(CAST(a % 10 AS DOUBLE) / 10.0)')} AS priority FROM (SELECT *, {STAT} AS stat_score FROM contingency)")
def _(s, p):
    scored = dp.signal_table(dp.contingency(d.stored_pairs(s, p)))
    tier = scores.priority(F.col("stat_score"), F.col("drug_reaction_count") % 10 / 10.0)
    return scored.select("drug_key", "pt", tier.alias("priority"))


MATCHED = "(SELECT s.*, 'item-' || CAST(drug_reaction_count % 40 AS VARCHAR) AS item FROM signals s)"


def _signal_queries(s, p):
    """Each signal searches with the query rows of one benchmark item; a stored table."""
    return d.stored(s, p, "signal-queries", lambda: _make_signal_queries(s, p))


def _make_signal_queries(s, p):
    signals = d.stored_signals(s, p).select(
        F.concat_ws("|", "drug_key", "pt").alias("sid"),
        F.concat(F.lit("item-"), (F.col("drug_reaction_count") % 40).cast("string")).alias("signal_id"),
    )
    return signals.join(d.literature_queries(s, p), "signal_id").drop("signal_id").withColumnRenamed("sid", "signal_id")


@query("investigation", f"""SELECT s.drug_key, s.pt, s.stat_score, coalesce(l.lit_score, 0.0) AS lit_score, coalesce(l.n_hits, 0) AS n_hits,
    {priority('s.stat_score', 'coalesce(l.lit_score, 0.0)')} AS priority,
    coalesce(nullif({outcome_parts('life-threatening')}, ''), 'no serious outcomes reported') AS severity
    FROM {MATCHED} s LEFT JOIN ({LIT_SQL}) l ON s.item = l.signal_id""")
def _(s, p):
    assessed, _hits = investigation.investigate(
        d.stored_signals(s, p), _signal_queries(s, p), d.corpus(s, p), min_similarity=0.2
    )
    return assessed.select("drug_key", "pt", "stat_score", "lit_score", "n_hits", "priority", "severity")


@query("investigated_additions", f"""SELECT s.drug_key, s.pt, s.stat_score, coalesce(l.lit_score, 0.0) AS lit_score, coalesce(l.n_hits, 0) AS n_hits,
    {priority('s.stat_score', 'coalesce(l.lit_score, 0.0)')} AS priority
    FROM {MATCHED} s LEFT JOIN ({LIT_SQL.replace("FROM fused", "FROM added_fused")}) l ON s.item = l.signal_id""")
def _(s, p):
    """New documents, search and assessment in one flow."""
    docs, index = _added_corpus(s, p)
    assessed, _hits = investigation.investigate(d.stored_signals(s, p), _signal_queries(s, p), docs, min_similarity=0.2, index=index)
    return assessed.select("drug_key", "pt", "stat_score", "lit_score", "n_hits", "priority")


# --- brief audit -----------------------------------------------------------------


def _known_briefs(s, p):
    counts = d.stored_signals(s, p).select(
        "drug_key", "pt", "prr", F.col("drug_reaction_count").alias("case_count"), "death_count", "lt_count", "hosp_count"
    )
    briefs = d.stored_briefs(s, p).withColumn("recommended_action", scores.normalize_action(F.col("recommended_action")))
    return briefs.join(counts, ["drug_key", "pt"])


@query("normalized_actions", f"SELECT drug_key, pt, recommended_action AS raw_action, {norm_action('recommended_action')} AS action FROM briefs")
def _(s, p):
    raw = F.col("recommended_action")
    return d.stored_briefs(s, p).select("drug_key", "pt", raw.alias("raw_action"), scores.normalize_action(raw).alias("action"))


@query("event_actions", f"SELECT event_id, {norm_action('props || event_type')} AS action FROM events")
def _(s, p):
    return d.table(s, p, "events").select(
        "event_id", scores.normalize_action(F.concat("props", "event_type")).alias("action")
    )


@query("guarded_citations", """SELECT drug_key, pt, array_to_string(list_filter(pmids_cited,
      lambda x: trim(ltrim(trim(x), 'PMID:')) IN (CAST(a + 1000000 AS VARCHAR), CAST(a + 1000001 AS VARCHAR), CAST(a + 1000002 AS VARCHAR))), ' | ') AS pmids_cited,
    CAST(CASE WHEN a % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS citations_removed FROM briefs""")
def _(s, p):
    return audit.guard_citations(d.stored_briefs(s, p), d.evidence(s, p)).select(
        "drug_key", "pt", joined("pmids_cited"), "citations_removed"
    )


@query("numeric_audit", f"SELECT drug_key, pt, {LIST.format('numeric_errors')}, round(numeric_rate, 6) AS numeric_rate FROM numeric")
def _(s, p):
    return audit.numeric_audit(_known_briefs(s, p)).select(
        "drug_key", "pt", joined("numeric_errors"), F.round("numeric_rate", 6).alias("numeric_rate")
    )


DOC_NUMERIC = f"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(lower(text), '{audit.PERCENT_PATTERN}', 1),
      lambda v: CAST(v AS DOUBLE)), lambda v: v > 100), lambda v: 'Invalid percentage: '
        || CASE WHEN v < 10000000 THEN CAST(v AS VARCHAR) ELSE printf('%.1f', v) END || '% (exceeds 100%)'), ' | ') AS percents,
    len(list_filter(list_transform(regexp_extract_all(lower(text), '{audit.YEAR_PATTERN}', 1), lambda v: CAST(v AS INTEGER)), lambda y: y < 2023 OR y > 2024)) AS n_years
    FROM documents"""


@query("document_number_checks", DOC_NUMERIC)
def _(s, p):
    text = F.lower("text")
    return d.library(s, p).select(
        "doc_id", F.array_join(audit.percent_errors(text), " | ").alias("percents"),
        F.size(audit.year_errors(text)).cast("long").alias("n_years"),
    )


@query("action_audit", f"SELECT drug_key, pt, {LIST.format('action_errors')}, round(action_rate, 6) AS action_rate FROM actions")
def _(s, p):
    return audit.action_audit(_known_briefs(s, p)).select(
        "drug_key", "pt", joined("action_errors"), F.round("action_rate", 6).alias("action_rate")
    )


@query("cited_claims", "SELECT drug_key, pt, pos, pmid, claim FROM claims")
def _(s, p):
    return audit.cited_claims(d.stored_briefs(s, p))


@query("claim_verdicts", "SELECT drug_key, pt, pos, pmid, round(similarity, 6) AS similarity, verdict FROM judged")
def _(s, p):
    claims = audit.cited_claims(d.stored_briefs(s, p))
    return audit.judge_claims(claims, d.evidence(s, p)).select(
        "drug_key", "pt", "pos", "pmid", F.round("similarity", 6).alias("similarity"), "verdict"
    )


@query("grounding_audit", f"SELECT drug_key, pt, {LIST.format('grounding_errors')}, round(CAST(n_bad AS DOUBLE) / n_claims, 6) AS grounding_rate, n_good AS grounded_claims FROM grounding")
def _(s, p):
    return audit.grounding_audit(d.stored_briefs(s, p), d.evidence(s, p)).select(
        "drug_key", "pt", joined("grounding_errors"), F.round("grounding_rate", 6).alias("grounding_rate"), "grounded_claims"
    )


@query("brief_audit", f"""SELECT drug_key, pt, {rnd('score', 3)} AS audit_score, score < CAST(0.2 AS DOUBLE) AS audit_pass,
    array_to_string(list_concat(list_concat(list_transform(numeric_errors, lambda e: '[numerical_accuracy] ' || e),
      list_transform(action_errors, lambda e: '[priority_consistency] ' || e)),
      list_transform(grounding_errors, lambda e: '[citation_grounding] ' || e)), ' | ') AS audit_flags FROM audited
    WHERE (drug_key, pt) IN (SELECT (drug_key, pt) FROM briefs WHERE NOT generation_error)""")
def _(s, p):
    briefs = d.stored_briefs(s, p)
    written = briefs.filter(~F.col("generation_error"))
    good, _bad = brief_audit.audit_briefs(written, d.stored_signals(s, p), d.evidence(s, p))
    return good.select("drug_key", "pt", "audit_score", "audit_pass", joined("audit_flags"))


@query("rejected_briefs", """SELECT drug_key, pt, concat_ws(' | ', CASE WHEN generation_error THEN 'brief_text required' END,
      CASE WHEN lit_score > 0.75 THEN 'lit_score in [0, 1]' END) AS violations
    FROM briefs WHERE generation_error OR lit_score > 0.75""")
def _(s, p):
    broken = d.stored_briefs(s, p).withColumns(
        {
            "brief_text": F.when(~F.col("generation_error"), F.col("brief_text")),
            "lit_score": F.when(F.col("lit_score") > 0.75, F.col("lit_score") + 1).otherwise(F.col("lit_score")),
        }
    )
    _good, bad = brief_audit.audit_briefs(broken, d.stored_signals(s, p), d.evidence(s, p))
    return bad.select("drug_key", "pt", joined("violations"))


CRITERIA = rubric.CRITERIA


@query("rubric_criteria", "SELECT drug_key, pt, priority, recommended_action, found, " + ", ".join(
    f"scorable AND coalesce(c{i}, false) AS {c}" for i, c in enumerate(CRITERIA, start=1)
) + ", scorable AND coalesce(c1 AND c2 AND c3 AND c4, false) AS overall_pass FROM rubric")
def _(s, p):
    briefs = _known_briefs(s, p)
    scored = rubric.score_briefs(d.golden(s, p), briefs)
    return scored.select("drug_key", "pt", "priority", "recommended_action", "found", *CRITERIA, "overall_pass")


@query("rubric_pass_rate", """SELECT count(*) AS total, count(*) FILTER (ok) AS passes, """ + ", ".join(
    f"count(*) FILTER (scorable AND c{i}) AS {c}_passes" for i, c in enumerate(CRITERIA, start=1)
) + """, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS pass_rate,
    CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) >= 0.7 AS target_met
    FROM (SELECT *, scorable AND coalesce(c1 AND c2 AND c3 AND c4, false) AS ok FROM rubric)""")
def _(s, p):
    return rubric.pass_rate(rubric.score_briefs(d.golden(s, p), _known_briefs(s, p)))


@query("rubric_reasons", """SELECT drug_key, pt, CASE WHEN NOT found THEN 'brief not found' WHEN NOT scorable THEN 'generation_error=True'
    WHEN c1 THEN 'pass' END AS signal_identification_reason, CASE WHEN NOT found THEN 'brief not found' WHEN NOT scorable THEN 'generation_error=True'
    WHEN c4 THEN 'pass (' || priority || ' → ' || recommended_action || ')'
    ELSE priority || ' cannot use ' || recommended_action || ' (valid: ' || CASE priority WHEN 'P2' THEN 'RESTRICT, LABEL_UPDATE, MONITOR'
      WHEN 'P3' THEN 'LABEL_UPDATE, MONITOR' ELSE 'MONITOR' END || ')' END AS tier_consistency_reason FROM rubric""")
def _(s, p):
    return rubric.score_briefs(d.golden(s, p), _known_briefs(s, p)).select(
        "drug_key", "pt", "signal_identification_reason", "tier_consistency_reason"
    )


# --- evaluation --------------------------------------------------------------------


def _leads(s, p):
    return evaluate.lead_times(d.golden(s, p), d.stored_pairs(s, p), d.stored_signals(s, p), 1.25, 32)


@query("first_seen_dates", f"SELECT drug_key, pt, {DAY.format('first_flagged_date')} FROM first_seen")
def _(s, p):
    return evaluate.first_seen(d.stored_pairs(s, p)).withColumn("first_flagged_date", day("first_flagged_date"))


@query("lead_times", f"""SELECT drug_key, pt, {DAY.format('comm_date')}, comm_label, {DAY.format('first_flagged_date')},
    lead_time_days, flagged, CASE WHEN lead_time_days IS NULL THEN 'not_detected' WHEN NOT flagged THEN 'not_flagged'
      WHEN lead_time_days > 0 THEN 'before_notice' ELSE 'after_notice' END AS lead_class FROM leads""")
def _(s, p):
    return evaluate.with_lead_class(_leads(s, p)).withColumns(
        {c: day(c) for c in ("comm_date", "first_flagged_date")}
    )


MEDIAN = "(SELECT lead_time_days FROM (SELECT lead_time_days, row_number() OVER (ORDER BY lead_time_days) AS r, count(*) OVER () AS n FROM leads WHERE lead_time_days IS NOT NULL) WHERE r = n // 2 + 1)"


@query("lead_summary", f"""SELECT {MEDIAN} AS median_lead_time, count(*) FILTER (lead_time_days > 0) AS positive_detections,
    count(*) AS total_golden, count(*) FILTER (flagged) AS flagged_count FROM leads""")
def _(s, p):
    return evaluate.lead_summary(_leads(s, p))


@query("golden_breakdown", """SELECT g.drug_key, g.pt, comm_label, m.drug_key IS NOT NULL AS flagged, m.prr, m.drug_reaction_count, m.stat_score
    FROM golden g LEFT JOIN meets m ON g.drug_key = m.drug_key AND g.pt = m.pt""")
def _(s, p):
    return evaluate.golden_breakdown(d.golden(s, p), d.stored_signals(s, p), 1.25, 32).drop("comm_date")


PRECISION = rnd("CAST(flagged AS DOUBLE) / total_golden", 3)


@query("golden_precision", f"""SELECT *, total_golden - flagged AS not_flagged, {PRECISION} AS precision, {PRECISION} AS golden_recall FROM (
    SELECT count(comm_date) AS total_golden, count(*) FILTER (flagged) AS flagged FROM leads)""")
def _(s, p):
    return evaluate.precision(evaluate.golden_breakdown(d.golden(s, p), d.stored_signals(s, p), 1.25, 32))


@query("evaluation_summary", f"""SELECT total_golden, flagged, precision_denominator - flagged AS not_flagged,
    {rnd('CAST(flagged AS DOUBLE) / precision_denominator', 3)} AS precision, precision_denominator, median_lead_time, positive_detections FROM (
      SELECT count(*) AS total_golden, count(*) FILTER (flagged AND comm_date IS NOT NULL) AS flagged, count(comm_date) AS precision_denominator,
        {MEDIAN} AS median_lead_time, count(*) FILTER (lead_time_days > 0) AS positive_detections FROM leads)""")
def _(s, p):
    return evaluate.summary(_leads(s, p))


# --- quality -------------------------------------------------------------------------


@query("row_range_check", """SELECT count(*) AS n_rows, CAST(1000 AS BIGINT) AS low, CAST(20000 AS BIGINT) AS high,
    CASE WHEN count(*) < 1000 THEN 'low' WHEN count(*) > 20000 THEN 'high' ELSE 'ok' END AS verdict FROM pairs""")
def _(s, p):
    return quality.row_range(d.stored_pairs(s, p), 1000, 20000)


@query("required_pairs_check", """SELECT g.drug_key, g.pt, count(q.primaryid) AS n_rows, count(q.primaryid) > 0 AS ok
    FROM golden g LEFT JOIN pairs q ON g.drug_key = q.drug_key AND g.pt = q.pt GROUP BY 1, 2""")
def _(s, p):
    return quality.required_pairs(d.stored_pairs(s, p), d.golden(s, p))


REQUIRED = (("brand#1", "nation"), ("GEAR", "nation_1"), ("absent", "nation_1"))


@query("required_signals_check", " UNION ALL ".join(
    f"SELECT '{a}' AS drug_text, '{b}' AS pt_text, count(*) AS n_rows, count(*) > 0 AS ok FROM signals WHERE contains(drug_key, lower('{a}')) AND contains(pt, '{b}')"
    for a, b in REQUIRED))
def _(s, p):
    return quality.required_signals(d.stored_signals(s, p), REQUIRED)


@query("junk_terms_left", "SELECT pt, count(*) AS n FROM contingency WHERE pt IN ('nation_3', 'nation_17') GROUP BY 1")
def _(s, p):
    return quality.junk_left(dp.contingency(d.stored_pairs(s, p)), d.JUNK)


@query("name_map_check", """SELECT prod_ai AS raw_name, canonical_name AS expected, canonical_name AS actual, true AS ok FROM raw_map
    UNION ALL SELECT DISTINCT upper(p_name), lower(p_name), 'NOT FOUND', false FROM part""")
def _(s, p):
    expected = d.raw_name_map(s, p).select(F.col("prod_ai").alias("raw_name"), F.col("canonical_name").alias("expected"))
    unknown = d.table(s, p, "part").select(F.upper("p_name").alias("raw_name"), F.lower("p_name").alias("expected")).distinct()
    return naming.check_names(d.name_map(s, p), expected.unionByName(unknown))


@query("columns_check", """SELECT 'drug_key' AS column_name, true AS present, count(drug_key) AS n_filled FROM pairs
    UNION ALL SELECT 'rxcui', true, count(rxcui) FROM pairs UNION ALL SELECT 'route', false, CAST(0 AS BIGINT)""")
def _(s, p):
    return quality.present_columns(d.stored_pairs(s, p), ["drug_key", "rxcui", "route"])


BROKEN_PAIRS = """SELECT primaryid, CASE WHEN primaryid % 11 = 0 THEN NULL WHEN primaryid % 5 = 0 THEN upper(drug_key) ELSE drug_key END AS drug_key,
    CASE WHEN primaryid % 7 = 0 THEN upper(pt) ELSE pt END AS pt FROM (SELECT * FROM pairs UNION ALL SELECT * FROM pairs WHERE primaryid % 13 = 0)"""


@query("readiness_check", f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN drug_key IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_keys,
    CAST(sum(CASE WHEN pt <> lower(pt) THEN n ELSE 0 END) AS BIGINT) AS upper_terms,
    CAST(sum(CASE WHEN drug_key <> lower(drug_key) THEN n ELSE 0 END) AS BIGINT) AS upper_drugs,
    count(*) FILTER (n > 1) AS duplicate_keys
    FROM (SELECT primaryid, drug_key, pt, count(*) AS n FROM ({BROKEN_PAIRS}) GROUP BY ALL)""")
def _(s, p):
    """Pairs broken on purpose: missing and upper-case keys, and rows that occur twice."""
    pairs_, id = d.stored_pairs(s, p), F.col("primaryid")
    broken = pairs_.unionByName(pairs_.where(id % 13 == 0)).withColumns(
        {
            "drug_key": F.when(id % 11 != 0, F.when(id % 5 == 0, F.upper("drug_key")).otherwise(F.col("drug_key"))),
            "pt": F.when(id % 7 == 0, F.upper("pt")).otherwise(F.col("pt")),
        }
    )
    return quality.readiness(broken)


@query("pair_violations", """SELECT concat_ws(' | ', CASE WHEN rxcui IS NULL THEN 'caseid required' END,
      CASE WHEN lt_flag = 1 THEN 'death_flag is 0 or 1' END) AS violations, count(*) AS n FROM pairs GROUP BY 1""")
def _(s, p):
    broken = d.stored_pairs(s, p).withColumns(
        {"caseid": F.when(F.col("rxcui").isNotNull(), F.col("caseid")),
         "death_flag": F.when(F.col("lt_flag") == 1, 2).otherwise(F.col("death_flag"))}
    )
    judged = quality.violations(broken, quality.pair_rules())
    return judged.groupBy(joined("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("signal_violations", """SELECT concat_ws(' | ', CASE WHEN a % 3 = 0 THEN 'prr > 0' END,
      CASE WHEN a % 5 = 0 THEN 'drug_total >= 0' END) AS violations, count(*) AS n FROM contingency GROUP BY 1""")
def _(s, p):
    n = F.col("drug_reaction_count")
    broken = dp.signal_table(dp.contingency(d.stored_pairs(s, p))).withColumns(
        {"prr": F.when(n % 3 == 0, -F.col("prr")).otherwise(F.col("prr")), "drug_total": F.when(n % 5 != 0, F.col("drug_total"))}
    )
    judged = quality.violations(broken, quality.signal_rules())
    return judged.groupBy(joined("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("stored_brief_violations", """SELECT CASE WHEN generation_error THEN '' ELSE 'priority is P1-P4 | priority set' END AS violations,
    count(*) AS n FROM briefs GROUP BY 1""")
def _(s, p):
    untiered = d.stored_briefs(s, p).withColumn("priority", F.lit(None).cast("string"))
    judged = quality.violations(untiered, quality.stored_brief_rules())
    return judged.groupBy(joined("violations")).agg(F.count(F.lit(1)).alias("n"))


# --- ledger --------------------------------------------------------------------------


@query("usage_by_task", """SELECT task, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS total_tokens, count(*) AS total_calls,
    CAST(sum(cost) AS DOUBLE) AS total_cost FROM costed GROUP BY 1""")
def _(s, p):
    return ledger.usage_by_task(d.calls(s, p)).withColumn("total_cost", F.col("total_cost").cast("double"))


@query("spend_by_day", f"""SELECT {DAY.format('day')}, CAST(sum(cost) AS DOUBLE) AS spent, CAST(0.04 - sum(cost) AS DOUBLE) AS remaining,
    sum(cost) > 0.04 AS over_budget FROM costed GROUP BY costed.day""")
def _(s, p):
    return ledger.spend_by_day(d.calls(s, p), "0.04").select(
        day("day"), F.col("spent").cast("double").alias("spent"), F.col("remaining").cast("double").alias("remaining"), "over_budget"
    )


@query("running_spend", """SELECT call_id, CAST(spent AS DOUBLE) AS spent, spent > 0.04 AS over_budget FROM (
    SELECT call_id, sum(cost) OVER (PARTITION BY day ORDER BY ts, call_id) AS spent FROM costed)""")
def _(s, p):
    return ledger.running_spend(d.calls(s, p), "0.04", order=("ts", "call_id"), runs=20).select(
        "call_id", F.col("spent").cast("double").alias("spent"), "over_budget"
    )


# --- incremental ingest ----------------------------------------------------------------


def _order_stream(s, p):
    schema = d.table(s, p, "orders").schema
    day_ = F.col("o_orderdate")
    rows = s.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(p)
    return rows.select(
        F.col("o_orderkey").alias("primaryid"), F.expr("o_orderkey div 2").alias("caseid"),
        (F.col("o_orderkey") % 2 + 1).cast("int").alias("caseversion"), F.date_format(day_, "yyyyMMdd").alias("fda_dt"),
        F.concat(F.year(day_), F.lit("Q"), F.quarter(day_)).alias("source_quarter"),
    )


@query("incremental_ingest", "SELECT primaryid, caseid, caseversion, fda_dt, source_quarter FROM demo")
def _(s, p):
    target, checkpoint = d.fresh_path(s, "ingested"), d.fresh_path(s, "ingest-state")
    for _run in range(2):  # the second run finds nothing new
        stream = messages.to_messages(_order_stream(s, p))
        ingest.ingest_available(stream, messages.SPECS["DEMO"], target, checkpoint).awaitTermination()
    return s.read.parquet(target).select("primaryid", "caseid", "caseversion", "fda_dt", "source_quarter")


@query("kept_case_versions", "SELECT * FROM latest")
def _(s, p):
    """Newest versions by a stateful aggregate over the stream, upserted into a table of one row per case."""
    target, checkpoint = d.fresh_path(s, "cases"), d.fresh_path(s, "case-state")
    ingest.keep_versions(_order_stream(s, p), target, checkpoint).awaitTermination()
    return ingest.kept_versions(s, target)


@query("streamed_case_versions", "SELECT * FROM latest")
def _(s, p):
    target, checkpoint = d.fresh_path(s, "versions"), d.fresh_path(s, "version-state")
    ingest.track_versions(_order_stream(s, p), target, checkpoint).awaitTermination()
    return ingest.current_versions(s, target)
