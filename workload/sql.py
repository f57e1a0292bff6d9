"""DuckDB SQL building blocks: named sub-queries and a composer for WITH lists."""

from __future__ import annotations

import re

from pharmasift.operators import audit
from workload import domain as d

# The whitespace characters of pharmasift.functions.text.SPACE, spelled out for RE2.
SPACE_CLASS = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def rnd(x: str, digits: int) -> str:
    """Correctly rounded decimal, ties to even on the binary value."""
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def fix(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST({x} AS DOUBLE))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE_CLASS}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"coalesce({words(f'lower({x})')}, CAST([] AS VARCHAR[]))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g')"


def quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


STAT = rnd(
    "least(prr / 4.0, 1.0) * 0.5 "
    "+ least(log10(CAST(greatest(a, 1) AS DOUBLE)) / log10(50.0), 1.0) * 0.3 "
    "+ (CASE WHEN death_count > 0 THEN 1.0 WHEN lt_count > 0 THEN 0.75 "
    "WHEN hosp_count > 0 THEN 0.5 ELSE 0.0 END) * 0.2",
    4,
)


def priority(stat: str, lit: str) -> str:
    return (
        f"CASE WHEN {stat} >= 0.7 AND {lit} >= 0.5 THEN 'P1' WHEN {stat} >= 0.7 THEN 'P2' "
        f"WHEN {lit} >= 0.5 THEN 'P3' ELSE 'P4' END"
    )


def pct(a: str, b: str) -> str:
    share = rnd(f"CAST({a} AS DOUBLE) / nullif({b}, 0) * 100.0", 1)
    return f"coalesce(CASE WHEN {b} <> 0 THEN {share} END, 0.0)"


def tier_rank(t: str, unknown: int = 5) -> str:
    return (
        f"CASE {t} WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 WHEN 'P4' THEN 4 "
        f"ELSE {unknown} END"
    )


L = d.LIMITS
CLAIM = "split_part(text, '.', 1)"
P_ACTION = (
    "CASE WHEN a % 7 = 0 THEN 'withdraw from market' WHEN a % 5 = 1 THEN 'Consider label revision' "
    "WHEN a % 3 = 0 THEN 'RESTRICT FOR PATIENTS OR REMOVE' WHEN a % 2 = 0 THEN 'restrict use' "
    "ELSE 'monitor' END"
)


def outcome_parts(lt_label: str) -> str:
    return (
        "concat_ws(', ', CASE WHEN death_count > 0 THEN CAST(death_count AS VARCHAR) || ' deaths' END, "
        f"CASE WHEN lt_count > 0 THEN CAST(lt_count AS VARCHAR) || ' {lt_label}' END, "
        "CASE WHEN hosp_count > 0 THEN CAST(hosp_count AS VARCHAR) || ' hospitalisations' END)"
    )


def norm_action(x: str) -> str:
    a = strip(f"upper(coalesce({x}, ''))")
    return (
        f"CASE WHEN {a} = '' THEN 'MONITOR' WHEN contains({a}, 'OR') AND length({a}) > 20 THEN 'MONITOR' "
        f"WHEN {a} IN ('MONITOR', 'LABEL_UPDATE', 'RESTRICT', 'WITHDRAW') THEN {a} "
        f"WHEN contains({a}, 'WITHDRAW') OR contains({a}, 'REMOVE') THEN 'WITHDRAW' "
        f"WHEN contains({a}, 'RESTRICT') OR contains({a}, 'LIMIT') THEN 'RESTRICT' "
        f"WHEN contains({a}, 'LABEL') OR contains({a}, 'UPDATE') OR contains({a}, 'REVISE') THEN 'LABEL_UPDATE' "
        "ELSE 'MONITOR' END"
    )


def bare(x: str) -> str:
    return f"trim(ltrim(trim({x}), 'PMID:'))"


NUM, AFTER = (f"regexp_extract_all(t, '{audit.NUMBER_PATTERN}', {g})" for g in (1, 2))
DEATH_CLAIM = " OR ".join(f"regexp_matches(t, '{p}')" for p in audit.DEATH_PATTERNS)

CTES: dict[str, str] = {
    "demo": """SELECT o_orderkey AS primaryid, o_orderkey // 2 AS caseid,
        CAST(o_orderkey % 2 + 1 AS INTEGER) AS caseversion, strftime(o_orderdate, '%Y%m%d') AS fda_dt,
        CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS source_quarter
        FROM orders""",
    "drug": """SELECT l_orderkey AS primaryid, l_orderkey // 2 AS caseid,
        CASE l_returnflag WHEN 'A' THEN 'PS' WHEN 'R' THEN 'SS' ELSE 'C' END AS role_cod,
        CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN upper(p_brand) || '\\' || upper(p_name)
             ELSE upper(p_brand) END AS prod_ai,
        p_name AS drugname
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "reac": """SELECT l_orderkey AS primaryid, n_name AS pt FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "outc": """SELECT l_orderkey AS primaryid,
        CASE l_linenumber WHEN 7 THEN 'DE' WHEN 6 THEN 'HO' WHEN 5 THEN 'LT' ELSE 'OT' END AS outc_cod
        FROM lineitem WHERE l_returnflag = 'R'""",
    "raw_map": """SELECT DISTINCT upper(p_brand) AS prod_ai, lower(p_brand) AS canonical_name,
        'RX' || split_part(p_brand, '#', 2) AS rxcui FROM part""",
    "name_map": """SELECT upper(trim(split_part(prod_ai, '\\', 1))) AS prod_ai_upper,
        min(canonical_name) AS canonical_name, min(rxcui) AS rxcui FROM raw_map
        WHERE canonical_name IS NOT NULL GROUP BY 1""",
    "latest": """SELECT primaryid, caseid, caseversion, fda_dt, source_quarter FROM (
        SELECT *, row_number() OVER (PARTITION BY caseid ORDER BY caseversion DESC, primaryid DESC) AS rn
        FROM demo) WHERE rn = 1""",
    "flags": """SELECT primaryid, max(CASE WHEN outc_cod = 'DE' THEN 1 ELSE 0 END) AS death_flag,
        max(CASE WHEN outc_cod = 'HO' THEN 1 ELSE 0 END) AS hosp_flag,
        max(CASE WHEN outc_cod = 'LT' THEN 1 ELSE 0 END) AS lt_flag FROM outc GROUP BY primaryid""",
    "facts": """SELECT l.primaryid, caseid, CAST(strptime(fda_dt, '%Y%m%d') AS DATE) AS fda_dt, source_quarter,
        coalesce(death_flag, 0) AS death_flag, coalesce(hosp_flag, 0) AS hosp_flag,
        coalesce(lt_flag, 0) AS lt_flag FROM latest l LEFT JOIN flags f ON l.primaryid = f.primaryid""",
    "named": """SELECT primaryid, caseid, role_cod, split_part(d.prod_ai, '\\', 1) AS prod_ai, drugname,
        m.rxcui, coalesce(m.canonical_name, lower(trim(split_part(d.prod_ai, '\\', 1))),
                          lower(trim(split_part(d.drugname, '\\', 1)))) AS drug_key
        FROM drug d LEFT JOIN name_map m ON upper(trim(split_part(d.prod_ai, '\\', 1))) = m.prod_ai_upper
        WHERE upper(role_cod) = 'PS'""",
    "drugs": """SELECT primaryid, drug_key, min(rxcui) AS rxcui FROM named
        WHERE drug_key IS NOT NULL GROUP BY 1, 2""",
    "reactions": "SELECT DISTINCT primaryid, lower(trim(pt)) AS pt FROM reac WHERE pt IS NOT NULL",
    "pairs": """SELECT g.primaryid, f.caseid, g.drug_key, g.rxcui, r.pt, f.fda_dt,
        f.death_flag, f.hosp_flag, f.lt_flag, f.source_quarter
        FROM drugs g JOIN reactions r ON g.primaryid = r.primaryid
        JOIN facts f ON g.primaryid = f.primaryid""",
    "cells": """SELECT drug_key, pt, count(DISTINCT primaryid) AS a,
        CAST(sum(death_flag) AS BIGINT) AS death_count, CAST(sum(hosp_flag) AS BIGINT) AS hosp_count,
        CAST(sum(lt_flag) AS BIGINT) AS lt_count FROM pairs GROUP BY 1, 2""",
    "by_drug": "SELECT drug_key, count(DISTINCT primaryid) AS drug_total FROM pairs GROUP BY 1",
    "by_pt": "SELECT pt, count(DISTINCT primaryid) AS reaction_total FROM pairs GROUP BY 1",
    "overall": "SELECT count(DISTINCT primaryid) AS n_total FROM pairs",
    "counted": """SELECT c.drug_key, c.pt, a, drug_total - a AS b, reaction_total - a AS c,
        n_total - drug_total - reaction_total + a AS d, drug_total, reaction_total,
        death_count, hosp_count, lt_count
        FROM cells c JOIN by_drug ON c.drug_key = by_drug.drug_key
        JOIN by_pt ON c.pt = by_pt.pt CROSS JOIN overall""",
    "contingency": """SELECT *, (CAST(a AS DOUBLE) / (a + b)) / (CAST(c AS DOUBLE) / (c + d)) AS prr
        FROM counted WHERE c > 0 AND c + d > 0 AND a + b > 0""",
    "candidates": f"""SELECT * FROM contingency WHERE a >= {L.cases} AND c >= {L.other_cases}
        AND drug_total >= {L.drug_cases} AND prr >= {L.prr} AND pt NOT IN ({quoted(d.JUNK)})""",
    "period_counts": """SELECT drug_key, pt, source_quarter, count(*) AS period_rows
        FROM pairs GROUP BY 1, 2, 3""",
    "shares": f"""SELECT drug_key, pt, max(period_rows) AS max_rows, CAST(sum(period_rows) AS BIGINT) AS total_rows,
        CAST(sum(CASE WHEN source_quarter IN ({quoted(d.LATE)}) THEN period_rows ELSE 0 END) AS BIGINT) AS late_rows
        FROM period_counts GROUP BY 1, 2""",
    "scope": f"""SELECT count(DISTINCT source_quarter) AS n_periods,
        coalesce(bool_or(source_quarter IN ({quoted(d.LATE)})), false) AS any_late FROM period_counts""",
    "clean": f"""SELECT drug_key, pt FROM shares CROSS JOIN scope
        WHERE (n_periods <= 1 OR CAST(max_rows AS DOUBLE) / total_rows <= {d.SPIKE_MAX})
        AND (NOT any_late OR CAST(late_rows AS DOUBLE) / total_rows <= {d.LATE_MAX})""",
    "signals": f"""SELECT drug_key, pt, prr, a AS drug_reaction_count, b AS drug_no_reaction_count,
        c AS other_reaction_count, d AS other_no_reaction_count, death_count, hosp_count, lt_count,
        drug_total, {STAT} AS stat_score FROM candidates
        WHERE (drug_key, pt) IN (SELECT (drug_key, pt) FROM clean)""",
    "signals_with_totals": "SELECT * FROM candidates WHERE (drug_key, pt) IN (SELECT (drug_key, pt) FROM clean)",
    "evidence": """SELECT drug_key, pt, j, CAST(drug_reaction_count + j + 1000000 AS VARCHAR) AS pmid, text
        FROM (SELECT *, unnest([0, 1, 2]) AS j FROM signals) s
        JOIN documents ON (drug_reaction_count * 7919 + other_reaction_count * 31 + j * 104729)
            % (SELECT count(*) FROM documents) = doc_id""",
    "brief_base": f"""SELECT s.*, drug_reaction_count AS a, CAST((drug_reaction_count % 10) AS DOUBLE) / 10.0 AS lit_score,
        e0.claim AS claim0, e1.claim AS claim1 FROM signals s
        JOIN (SELECT drug_key, pt, {CLAIM} AS claim FROM evidence WHERE j = 0) e0
          ON s.drug_key = e0.drug_key AND s.pt = e0.pt
        JOIN (SELECT drug_key, pt, {CLAIM} AS claim FROM evidence WHERE j = 1) e1
          ON s.drug_key = e1.drug_key AND s.pt = e1.pt
        WHERE length(s.drug_key || s.pt) % 5 <> 0""",
    "briefs": f"""SELECT a * 1000000 + other_reaction_count AS brief_id, drug_key, pt, stat_score, lit_score,
        {priority('stat_score', 'lit_score')} AS priority,
        array_to_string(list_transform(string_split(drug_key, ' '),
            lambda w: upper(left(w, 1)) || substring(w, 2)), ' ')
        || ' with ' || pt || ' shows a PRR of '
        || CASE WHEN a % 5 = 0 THEN {fix('prr * 1.5', 1)} ELSE {fix('prr', 2)} END
        || ' based on ' || CAST(CASE WHEN a % 4 = 0 THEN a * 2 ELSE a END AS VARCHAR) || ' reports in 2023. '
        || CASE WHEN a % 6 = 0 THEN 'No deaths were seen.' ELSE CAST(death_count AS VARCHAR) || ' deaths occurred.' END
        || CASE WHEN a % 9 = 0 THEN ' Incidence rose by 140.5% since 2019.' ELSE '' END
        || ' [PMID:' || CAST(a + 1000000 AS VARCHAR) || '] ' || claim0
        || '. [PMID: ' || CAST(a + 1000001 AS VARCHAR) || '] '
        || CASE WHEN a % 2 = 0 THEN 'the mechanism of this reaction remains entirely unclear' ELSE claim1 END
        || '. [PMID:' || CAST(CASE WHEN a % 3 = 0 THEN a + 2000000 ELSE a + 1000000 END AS VARCHAR)
        || '] see there.' AS brief_text,
        CASE WHEN a % 13 = 0 THEN 'not json'
             ELSE '["' || pt || '", "n=' || CAST(a AS VARCHAR) || '"]' END AS key_findings,
        list_concat(['PMID:' || CAST(a + 1000000 AS VARCHAR), CAST(a + 1000001 AS VARCHAR)],
            CASE WHEN a % 3 = 0 THEN [CAST(a + 2000000 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END) AS pmids_cited,
        {P_ACTION} AS recommended_action, 'm1' AS model_used, a * 10 AS input_tokens,
        other_reaction_count AS output_tokens, a % 11 = 0 AS generation_error,
        to_timestamp(a + 1704067200) AT TIME ZONE 'UTC' AS generated_at,
        a, prr, death_count, hosp_count, lt_count FROM brief_base""",
    "submitted": """SELECT 'brand#' || CAST(user_id % 100 + 1 AS VARCHAR) AS drug_key,
        'nation_' || CAST(event_id % 100 AS VARCHAR) AS pt,
        CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'REJECT' ELSE event_type END AS decision,
        props AS reviewer_note, ts AS decided_at FROM events""",
    "decisions": """SELECT drug_key, pt, upper(decision) AS decision, reviewer_note, decided_at FROM submitted
        WHERE upper(decision) IN ('APPROVE', 'REJECT')""",
    "latest_decision": """SELECT drug_key, pt, decision FROM (
        SELECT *, row_number() OVER (PARTITION BY drug_key, pt ORDER BY decided_at DESC, decision DESC) AS rn
        FROM decisions) WHERE rn = 1""",
    "golden": """SELECT drug_key, pt, CASE WHEN b % 12 = 0 THEN NULL
            WHEN k % 4 = 1 THEN DATE '1995-01-02' + b ELSE DATE '1997-01-01' + (b * 30 + k) END AS comm_date,
        'Notice ' || CAST(b AS VARCHAR) AS comm_label
        FROM (SELECT DISTINCT lower(p_brand) AS drug_key, lower(n_name) AS pt,
              CAST(split_part(p_brand, '#', 2) AS INTEGER) AS b, n_nationkey AS k
              FROM part JOIN nation ON p_size % 25 = n_nationkey)""",
    "feed": """SELECT s.*, b.lit_score, b.priority, b.generation_error, h.decision AS hitl_decision
        FROM signals s LEFT JOIN briefs b ON s.drug_key = b.drug_key AND s.pt = b.pt
        LEFT JOIN latest_decision h ON s.drug_key = h.drug_key AND s.pt = h.pt""",
    "ready": """SELECT * FROM briefs b WHERE NOT generation_error AND NOT EXISTS (
        SELECT 1 FROM decisions h WHERE h.drug_key = b.drug_key AND h.pt = b.pt)""",
    "meets": """SELECT * FROM signals WHERE prr >= 1.25 AND drug_reaction_count >= 32""",
    "first_seen": "SELECT drug_key, pt, min(fda_dt) AS first_flagged_date FROM pairs GROUP BY 1, 2",
    "leads": """SELECT g.drug_key, g.pt, g.comm_date, g.comm_label, first_flagged_date,
        CAST(date_diff('day', first_flagged_date, comm_date) AS INTEGER) AS lead_time_days,
        m.drug_key IS NOT NULL AS flagged
        FROM golden g LEFT JOIN first_seen f ON g.drug_key = f.drug_key AND g.pt = f.pt
        LEFT JOIN meets m ON g.drug_key = m.drug_key AND g.pt = m.pt""",
    "corpus": """SELECT doc_id, CAST(coalesce(label, doc_id % 10) AS VARCHAR) AS group_key, text,
        CAST(embedding AS DOUBLE[]) AS embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "items": """SELECT q.item_id, q.query_no, b.text FROM (
        SELECT item_id, unnest([1, 2, 3]) AS query_no, (SELECT count(*) FROM benchmark) AS n FROM benchmark) q
        JOIN benchmark b ON (q.item_id + q.query_no - 1) % q.n = b.item_id""",
    "lit_queries": """SELECT 'item-' || CAST(item_id AS VARCHAR) AS signal_id, query_no,
        CAST(item_id % 10 AS VARCHAR) AS group_key, text, CAST(embedding AS DOUBLE[]) AS embedding
        FROM items JOIN embeddings ON item_id * 3 + query_no - 1 = vec_id""",
    "dense_scored": """SELECT signal_id, query_no, c.doc_id,
        list_inner_product(q.embedding, c.embedding) / (sqrt(list_inner_product(q.embedding, q.embedding))
          * sqrt(list_inner_product(c.embedding, c.embedding))) AS score
        FROM lit_queries q JOIN corpus c ON q.group_key = c.group_key""",
    "dense_hits": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, query_no
        ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dense_scored WHERE score >= 0.2) WHERE rank <= 10""",
    "sparse_hits": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, query_no
        ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25_corpus_scored WHERE score >= 0.1) WHERE rank <= 10""",
    "hits": f"""SELECT signal_id, query_no, 'hnsw' AS retriever, rank, doc_id, score,
          {rnd('score', 4)} AS similarity, 1.0 - score AS distance FROM dense_hits
        UNION ALL SELECT signal_id, query_no, 'bm25', rank, doc_id, score,
          {rnd('least(score / 10.0, 1.0)', 4)}, 1.0 - least(score / 10.0, 1.0) FROM sparse_hits""",
    "grouped_hits": """SELECT signal_id, doc_id,
        list_reduce(list(CAST(1 AS DOUBLE) / (rank + 60) ORDER BY list_no), lambda x, y: x + y) AS rrf_score,
        min(CASE WHEN retriever = 'hnsw' THEN distance END) AS dense,
        min(CASE WHEN retriever = 'bm25' THEN distance END) AS sparse,
        min(list_no * 1000 + rank) AS first_seen
        FROM (SELECT *, query_no * 2 + CASE WHEN retriever = 'bm25' THEN 1 ELSE 0 END AS list_no FROM hits)
        GROUP BY 1, 2""",
    "fused": f"""SELECT signal_id, doc_id, rrf_score, {rnd('1.0 - coalesce(dense, sparse)', 4)} AS similarity,
        CASE WHEN dense IS NOT NULL THEN 'hnsw' ELSE 'bm25' END AS retriever,
        row_number() OVER (PARTITION BY signal_id ORDER BY rrf_score DESC, first_seen, doc_id) AS fused_rank
        FROM grouped_hits""",
    "item_signals": "SELECT 'item-' || CAST(item_id AS VARCHAR) AS signal_id FROM benchmark",
    "library": "SELECT doc_id, source AS group_key, text FROM documents",
    "lib_queries": """SELECT 'item-' || CAST(item_id AS VARCHAR) AS signal_id, query_no,
        'src' || CAST(item_id % 20 AS VARCHAR) AS group_key, text FROM items""",
    "calls": """SELECT event_id AS call_id, ts, CAST(ts AS DATE) AS day,
        CASE WHEN event_type IN ('view', 'click') THEN 'query_generation' ELSE 'brief_generation' END AS task,
        CAST(floor(value * 100) AS BIGINT) AS input_tokens, user_id AS output_tokens FROM events""",
    "costed": """SELECT *, CAST(CAST(input_tokens AS DECIMAL(18,8)) * 0.00000015
          + CAST(output_tokens AS DECIMAL(18,8)) * 0.0000006 AS DECIMAL(18,8)) AS cost FROM calls""",
    # --- audit -------------------------------------------------------------
    "acted": f"""SELECT * REPLACE ({norm_action('recommended_action')} AS recommended_action),
        a AS case_count FROM briefs""",
    "numeric": f"""SELECT *, least(len(numeric_errors) / 3.0, 1.0) AS numeric_rate FROM (
        SELECT *, list_concat(list_concat(list_concat(list_concat(
          list_transform(list_filter(list_transform(regexp_extract_all(t, '{audit.RATIO_PATTERN}', 1),
              lambda v: CAST(v AS DOUBLE)), lambda v: abs(v - prr) > prr * CAST(0.1 AS DOUBLE)),
              lambda v: 'Hallucinated PRR: claimed ' || {fix('v', 2)} || ', actual ' || {fix('prr', 2)}),
          list_transform(list_filter(range(1, len({NUM}) + 1),
              lambda i: (contains({AFTER}[i], 'case') OR contains({AFTER}[i], 'report') OR contains({AFTER}[i], 'event'))
                AND CAST({NUM}[i] AS DOUBLE) > 10
                AND abs(floor(CAST({NUM}[i] AS DOUBLE)) - case_count) > case_count * CAST(0.2 AS DOUBLE)),
              lambda i: 'Hallucinated case count: claimed ' || printf('%.0f', floor(CAST({NUM}[i] AS DOUBLE)))
                || ', actual ' || CAST(case_count AS VARCHAR))),
          list_filter([CASE WHEN death_count > 0 AND (contains(t, 'no death') OR contains(t, 'zero death') OR contains(t, 'no fatal'))
              THEN 'Claims no deaths but ' || CAST(death_count AS VARCHAR) || ' deaths reported' END,
            CASE WHEN death_count = 0 AND ({DEATH_CLAIM})
              THEN 'Claims deaths occurred but data shows 0 deaths' END], lambda e: e IS NOT NULL)),
          list_transform(list_filter(list_transform(regexp_extract_all(t, '{audit.PERCENT_PATTERN}', 1),
              lambda v: CAST(v AS DOUBLE)), lambda v: v > 100),
              lambda v: 'Invalid percentage: ' || CAST(v AS VARCHAR) || '% (exceeds 100%)')),
          list_transform(list_filter(list_transform(regexp_extract_all(t, '{audit.YEAR_PATTERN}', 1),
              lambda v: CAST(v AS INTEGER)), lambda y: y < 2023 OR y > 2024),
              lambda y: 'Suspicious date: ' || CAST(y AS VARCHAR)
                || ' (FAERS data is 2023, FDA comm may be 2024)')) AS numeric_errors
        FROM (SELECT *, lower(brief_text) AS t FROM acted))""",
    "actions": f"""SELECT *, least(len(action_errors) / 2.0, 1.0) AS action_rate FROM (
        SELECT *, list_filter([
          CASE WHEN NOT (priority = 'P1' OR (priority = 'P2' AND recommended_action <> 'WITHDRAW')
              OR (priority IN ('P3', 'P4') AND recommended_action IN ('LABEL_UPDATE', 'MONITOR')))
            THEN 'Priority-action mismatch: ' || priority || ' should use ' || CASE priority
              WHEN 'P2' THEN '[''LABEL_UPDATE'', ''RESTRICT'', ''MONITOR'']'
              WHEN 'P3' THEN '[''LABEL_UPDATE'', ''MONITOR'']' ELSE '[''MONITOR'', ''LABEL_UPDATE'']' END
              || ', not ' || recommended_action END,
          CASE WHEN recommended_action = 'WITHDRAW' AND death_count = 0
            THEN 'WITHDRAW without deaths — should be RESTRICT or LABEL_UPDATE' END,
          CASE WHEN recommended_action = 'WITHDRAW' AND prr < 10
            THEN 'WITHDRAW with low PRR (' || {fix('prr', 2)} || ') — threshold is PRR > 10' END,
          CASE WHEN recommended_action = 'RESTRICT' AND death_count = 0 AND lt_count = 0
              THEN 'RESTRICT without deaths or life-threatening events — should be LABEL_UPDATE or MONITOR'
            WHEN recommended_action = 'RESTRICT' AND death_count > 0 AND prr < 2
              THEN 'RESTRICT with deaths but PRR < 2 (' || {fix('prr', 2)} || ') — threshold is PRR > 2 when deaths present'
            WHEN recommended_action = 'RESTRICT' AND death_count = 0 AND lt_count > 0 AND prr < 5
              THEN 'RESTRICT with LT events but PRR < 5 (' || {fix('prr', 2)}
                || ') — threshold is PRR > 5 when only LT events (no deaths)' END,
          CASE WHEN recommended_action = 'LABEL_UPDATE' AND prr < 2
            THEN 'LABEL_UPDATE with PRR < 2 (' || {fix('prr', 2)} || ') — signal may not meet threshold' END,
          CASE WHEN recommended_action = 'MONITOR' AND priority IN ('P1', 'P2')
              AND (death_count > 0 OR lt_count > 0 OR hosp_count > 0) AND prr > 3
            THEN 'MONITOR for ' || priority || ' signal with serious outcomes (deaths=' || CAST(death_count AS VARCHAR)
              || ', lt=' || CAST(lt_count AS VARCHAR) || ', hosp=' || CAST(hosp_count AS VARCHAR) || ') and PRR '
              || {fix('prr', 2)} || ' — consider LABEL_UPDATE or RESTRICT' END
          ], lambda e: e IS NOT NULL) AS action_errors FROM acted)""",
    "claims": f"""SELECT drug_key, pt, CAST(pos - 1 AS INTEGER) AS pos, ids[pos] AS pmid, {strip('texts[pos]')} AS claim FROM (
        SELECT *, unnest(range(1, len(ids) + 1)) AS pos FROM (
          SELECT drug_key, pt, regexp_extract_all(brief_text, '{audit.CITATION_PATTERN}', 1) AS ids,
            regexp_extract_all(brief_text, '{audit.CITATION_PATTERN}', 2) AS texts FROM acted))""",
    "judged": f"""SELECT *, CASE WHEN len({words('claim')}) < 5 THEN 'short' WHEN evidence_text IS NULL THEN 'unknown'
          WHEN similarity < 0.5 THEN 'ungrounded' ELSE 'grounded' END AS verdict FROM (
        SELECT *, CASE WHEN evidence_text IS NOT NULL THEN coalesce(
            list_sum(list_transform(map_keys(ct), lambda x: ct[x] * coalesce(et[x], 0)))
            / nullif(sqrt(CAST(list_sum(list_transform(map_values(ct), lambda n: n * n)) AS DOUBLE))
              * sqrt(CAST(list_sum(list_transform(map_values(et), lambda n: n * n)) AS DOUBLE)), 0), 0.0) END AS similarity
        FROM (SELECT c.*, e.text AS evidence_text, list_aggregate({tokens('c.claim')}, 'histogram') AS ct,
          list_aggregate({tokens('e.text')}, 'histogram') AS et
          FROM claims c LEFT JOIN evidence e ON c.drug_key = e.drug_key AND c.pt = e.pt AND c.pmid = e.pmid))""",
    "grounding": f"""SELECT c.drug_key, c.pt, count(*) AS n_claims,
        count(*) FILTER (verdict = 'ungrounded') AS n_bad, count(*) FILTER (verdict = 'grounded') AS n_good,
        coalesce(list(CASE verdict WHEN 'unknown' THEN 'Cited PMID ' || pmid || ' not in retrieved set'
            ELSE 'Claim not grounded in PMID ' || pmid || ' (similarity ' || {fix('similarity', 2)}
              || ' < 0.5): ' || claim END ORDER BY verdict DESC, pos)
            FILTER (verdict IN ('unknown', 'ungrounded')), CAST([] AS VARCHAR[])) AS grounding_errors
        FROM judged c GROUP BY 1, 2""",
    "audited": """SELECT n.drug_key, n.pt, numeric_errors, numeric_rate, action_errors, action_rate,
        grounding_errors, CAST(n_bad AS DOUBLE) / n_claims AS grounding_rate,
        numeric_rate * CAST(0.4 AS DOUBLE) + action_rate * CAST(0.3 AS DOUBLE)
          + (CAST(n_bad AS DOUBLE) / n_claims) * CAST(0.3 AS DOUBLE) AS score
        FROM numeric n JOIN actions a ON n.drug_key = a.drug_key AND n.pt = a.pt
        JOIN grounding g ON n.drug_key = g.drug_key AND n.pt = g.pt""",
    "rubric": """SELECT g.drug_key, g.pt, b.priority, b.recommended_action, b.drug_key IS NOT NULL AS found,
        b.drug_key IS NOT NULL AND NOT b.generation_error AS scorable,
        contains(lower(brief_text), b.drug_key) AND contains(lower(brief_text), b.pt) AS c1,
        len(list_filter(pmids_cited, lambda p: contains(brief_text, p))) > 0
          OR regexp_matches(brief_text, '(?i)PMID[:\\s]\\d+') AS c2,
        len(list_filter(regexp_extract_all(brief_text, '(?i)PMID[:\\s]?(\\d{7,9})', 1),
          lambda m: NOT list_contains(pmids_cited, m))) = 0 AS c3,
        b.priority = 'P1' OR (b.priority = 'P2' AND b.recommended_action <> 'WITHDRAW')
          OR (b.priority = 'P3' AND b.recommended_action IN ('LABEL_UPDATE', 'MONITOR'))
          OR (b.priority = 'P4' AND b.recommended_action = 'MONITOR') AS c4
        FROM golden g LEFT JOIN acted b ON g.drug_key = b.drug_key AND g.pt = b.pt""",
}


def bm25_ctes(prefix: str, docs: str, queries: str) -> dict[str, str]:
    p = prefix
    return {
        f"{p}_tokens": f"SELECT doc_id, group_key, {tokens('text')} AS toks FROM {docs}",
        f"{p}_postings": f"""SELECT doc_id, group_key, term, count(*) AS tf
            FROM (SELECT doc_id, group_key, unnest(toks) AS term FROM {p}_tokens) GROUP BY ALL""",
        f"{p}_stats": f"""SELECT count(*) AS n_docs, CAST(sum(len(toks)) AS DOUBLE) / count(*) AS mean_tokens
            FROM {p}_tokens""",
        f"{p}_raw": f"""SELECT term, df, ln(n_docs - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS raw
            FROM (SELECT term, count(*) AS df FROM {p}_postings GROUP BY term) CROSS JOIN {p}_stats""",
        f"{p}_idf": f"""SELECT term, df, CASE WHEN raw < 0 THEN mean_raw * 0.25 ELSE raw END AS idf
            FROM (SELECT *, avg(raw) OVER () AS mean_raw FROM {p}_raw)""",
        f"{p}_terms": f"""SELECT signal_id, query_no, group_key, term, count(*) AS qtf
            FROM (SELECT signal_id, query_no, group_key, unnest({tokens('text')}) AS term FROM {queries}) GROUP BY ALL""",
        f"{p}_scored": f"""SELECT signal_id, query_no, o.doc_id, sum(qtf * idf * (tf * 2.5)
              / (tf + 1.5 * (0.25 + 0.75 * len(toks) / mean_tokens))) AS score
            FROM {p}_terms q JOIN {p}_postings o ON q.group_key = o.group_key AND q.term = o.term
            JOIN {p}_idf i ON q.term = i.term JOIN {p}_tokens t ON o.doc_id = t.doc_id CROSS JOIN {p}_stats
            GROUP BY 1, 2, 3""",
    }


CTES = {**CTES, **bm25_ctes("bm25_corpus", "corpus", "lit_queries"), **bm25_ctes("bm25_library", "library", "lib_queries")}
# The same search over a corpus whose second half was added by new_documents; ids are texts.
CTES["added"] = """SELECT group_key || '_' || CAST(doc_id AS VARCHAR) AS doc_id, group_key,
    CASE WHEN doc_id % 2 = 1 THEN 'Title ' || CAST(doc_id AS VARCHAR) || ' ' || text ELSE text END AS text, embedding
    FROM corpus WHERE doc_id % 2 = 0 OR trim(text) <> ''"""
CTES |= bm25_ctes("bm25_added", "added", "lit_queries")
_RENAMED = {"corpus": "added", "bm25_corpus_scored": "bm25_added_scored"} | {
    n: f"added_{n}" for n in ("dense_scored", "dense_hits", "sparse_hits", "hits", "grouped_hits", "fused")
}
for _name in ("dense_scored", "dense_hits", "sparse_hits", "hits", "grouped_hits", "fused"):
    CTES[_RENAMED[_name]] = re.sub(
        r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {_RENAMED.get(m[2], m[2])}", CTES[_name]
    )
_ORDER = list(CTES)


def compose(body: str) -> str:
    """Prefix a query with the sub-queries it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _ORDER:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body
