from pyspark.sql import functions as F

from pharmasift.operators import audit, rubric
from pharmasift.plans.brief_audit import audit_briefs
from tests.conftest import rows

STATE = "drug_key string, pt string, brief_text string, prr double, case_count long, death_count long, lt_count long, hosp_count long, priority string, recommended_action string, pmids_cited array<string>"


def brief(text, prr=3.5, cases=120, deaths=5, lt=0, hosp=0, tier="P1", action="LABEL_UPDATE", cited=(), pt="p"):
    return ("d", pt, text, prr, cases, deaths, lt, hosp, tier, action, list(cited))


def numeric(frame, *args, **kw):
    r = audit.numeric_audit(frame([brief(*args, **kw)], STATE)).first()
    return r.numeric_errors, round(r.numeric_rate, 4)


def action(frame, **kw):
    r = audit.action_audit(frame([brief("t", **kw)], STATE)).first()
    return r.action_errors, r.action_rate


def test_correct_numbers_pass(frame):
    assert numeric(frame, "PRR of 3.5 with 120 cases and 5 deaths in 2023; 12.5% of reports.") == ([], 0.0)
    assert numeric(frame, None, deaths=0) == ([], 0.0)


def test_wrong_ratio_is_named(frame):
    errors, rate = numeric(frame, "Proportional reporting ratio 3.8; PRR: 10.5")
    assert errors == ["Hallucinated PRR: claimed 10.50, actual 3.50"] and rate == 0.3333


def test_case_counts(frame):
    assert numeric(frame, "about 300 reports")[0] == ["Hallucinated case count: claimed 300, actual 120"]
    assert numeric(frame, "100 cases, 9 events, 140.9 reported events, 500 mg dose") == ([], 0.0)
    # a thousands separator splits the number, as in the original rule
    assert numeric(frame, "1,200 cases", cases=1200)[0] == ["Hallucinated case count: claimed 200, actual 1200"]


def test_death_claims(frame):
    assert numeric(frame, "No deaths seen")[0] == ["Claims no deaths but 5 deaths reported"]
    assert numeric(frame, "no deaths seen", deaths=0) == ([], 0.0)
    assert numeric(frame, "One resulted in  death", deaths=0)[0] == ["Claims deaths occurred but data shows 0 deaths"]


def test_percentages_and_years(frame):
    errors, rate = numeric(frame, "rose 150% and 100% since 2019, 1999 and 2024")
    assert errors == [
        "Invalid percentage: 150.0% (exceeds 100%)",
        "Suspicious date: 2019 (FAERS data is 2023, FDA comm may be 2024)",
        "Suspicious date: 1999 (FAERS data is 2023, FDA comm may be 2024)",
    ]
    assert rate == 1.0


def test_huge_numbers_do_not_fail(frame):
    errors, _ = numeric(frame, "99999999999999999999 cases and 12345678%")
    assert errors[0].startswith("Hallucinated case count: claimed 100000000000000000000")
    assert errors[1] == "Invalid percentage: 12345678.0% (exceeds 100%)"


def test_action_rules(frame):
    assert action(frame) == ([], 0.0)
    errors, rate = action(frame, tier="P4", action="WITHDRAW", deaths=0)
    assert rate == 1.0 and errors == [
        "Priority-action mismatch: P4 should use ['MONITOR', 'LABEL_UPDATE'], not WITHDRAW",
        "WITHDRAW without deaths — should be RESTRICT or LABEL_UPDATE",
        "WITHDRAW with low PRR (3.50) — threshold is PRR > 10",
    ]
    assert action(frame, action="RESTRICT", deaths=0, lt=2, prr=4.0)[0][0].startswith("RESTRICT with LT events but PRR < 5 (4.00)")
    assert action(frame, action="RESTRICT", deaths=0)[0][0].startswith("RESTRICT without deaths")
    assert action(frame, action="RESTRICT", prr=1.5)[0][0].startswith("RESTRICT with deaths but PRR < 2 (1.50)")
    assert action(frame, action="LABEL_UPDATE", prr=1.5)[0] == ["LABEL_UPDATE with PRR < 2 (1.50) — signal may not meet threshold"]
    assert "deaths=0, lt=0, hosp=3) and PRR 4.00" in action(frame, action="MONITOR", deaths=0, hosp=3, prr=4.0)[0][0]
    assert action(frame, action="MONITOR", deaths=0, prr=9.0) == ([], 0.0)
    assert action(frame, tier="P4", action="LABEL_UPDATE") == ([], 0.0)


EVIDENCE = "drug_key string, pt string, pmid string, text string"


def grounded(frame, text, evidence):
    b = frame([brief(text)], STATE)
    r = audit.grounding_audit(b, frame(evidence, EVIDENCE)).first()
    return r.grounding_errors, round(r.grounding_rate, 4), r.grounded_claims


def test_grounding(frame):
    proof = [("d", "p", "11", "the drug causes dry eyes in many adults"), ("d", "p", "12", "unrelated words only here now")]
    assert grounded(frame, "Plain text.", []) == (["No abstracts available for grounding check"], 0.0, 0)
    assert grounded(frame, "Plain text.", proof) == ([], 0.0, 0)
    assert grounded(frame, "[PMID:11] the drug causes dry eyes. [pmid: 11] too short.", proof) == ([], 0.0, 1)
    errors, rate, good = grounded(
        frame, "[PMID:12] the drug causes dry eyes. [PMID:99] the drug causes dry eyes too. [PMID:11] the drug causes dry eyes.", proof
    )
    assert errors == [
        "Cited PMID 99 not in retrieved set",
        "Claim not grounded in PMID 12 (similarity 0.00 < 0.5): the drug causes dry eyes.",
    ]
    assert (rate, good) == (0.3333, 1)


def test_composite_uses_the_unrounded_score(frame):
    schema = "numeric_rate double, action_rate double, grounding_rate double, numeric_errors array<string>, action_errors array<string>, grounding_errors array<string>"
    df = frame([(0.0, 0.0, 0.0, [], [], []), (1 / 3, 0.0, 0.2217, ["n"], ["a"], ["g"]), (0.5, 0.0, 0.0, [], [], [])], schema)
    got = audit.composite(df).collect()
    assert [(r.audit_score, r.audit_pass) for r in got] == [(0.0, True), (0.2, True), (0.2, False)]
    assert got[1].audit_flags == ["[numerical_accuracy] n", "[priority_consistency] a", "[citation_grounding] g"]


def test_citation_guard_keeps_order(frame):
    b = frame([brief("t", cited=["PMID: 12", "77", "11"]), brief("t", cited=[], pt="q")], STATE)
    ev = frame([("d", "p", " 11", "x"), ("d", "p", "PMID:12", "x")], EVIDENCE)
    got = {r.pt: (r.pmids_cited, r.citations_removed) for r in audit.guard_citations(b, ev).collect()}
    assert got == {"p": (["PMID: 12", "11"], 1), "q": ([], 0)}


def test_audit_splits_and_scores(frame):
    schema = "drug_key string, pt string, brief_text string, key_findings array<string>, pmids_cited array<string>, search_queries array<string>, recommended_action string, stat_score double, lit_score double, priority string, generated_at string"
    ok = ("d", "p", "PRR of 3.5", ["f"], ["11", "99"], ["q"], "update label", 0.8, 0.6, "P1", "now")
    bad = ("d", "q", None, ["f"], [], [], "x", 1.8, 0.6, "P9", "now")
    signals = frame([("d", "p", 3.5, 120, 5, 0, 0), ("d", "q", 3.5, 120, 5, 0, 0)],
                    "drug_key string, pt string, prr double, drug_reaction_count long, death_count long, lt_count long, hosp_count long")
    good, rejected = audit_briefs(frame([ok, bad], schema), signals, frame([("d", "p", "11", "t")], EVIDENCE))
    r = good.collect()
    assert len(r) == 1 and r[0].audit_pass and r[0].recommended_action == "LABEL_UPDATE" and r[0].pmids_cited == ["11"]
    assert rejected.first().violations == [
        "brief_text required", "search_queries has 1-5 entries", "priority is P1-P4", "stat_score in [0, 1]"
    ]


def test_rubric(frame):
    schema = "drug_key string, pt string, priority string, brief_text string, pmids_cited array<string>, recommended_action string, generation_error boolean"
    briefs = frame(
        [("d", "ok", "P1", "D with OK [PMID:1234567]", ["1234567"], "monitor", False),
         ("d", "fake", "P4", "d with fake PMID 7654321", [], "LABEL_UPDATE", False),
         ("d", "none", "P2", "nothing", ["1"], None, False), ("d", "err", None, None, None, None, True)],
        schema,
    )
    golden = frame([("d", p) for p in ("ok", "fake", "none", "err", "gone")], "drug_key string, pt string")
    scored = rubric.score_briefs(golden, briefs)
    got = {r.pt: r for r in scored.collect()}
    assert got["ok"].overall_pass and got["ok"].tier_consistency_reason == "pass (P1 → MONITOR)"
    assert got["fake"].literature_grounding and not got["fake"].citation_accuracy
    assert got["fake"].citation_accuracy_reason == "fabricated PMIDs: 7654321"
    assert got["fake"].tier_consistency_reason == "P4 cannot use LABEL_UPDATE (valid: MONITOR)"
    assert got["none"].signal_identification_reason == "missing: drug 'd', reaction 'none'" or not got["none"].signal_identification
    assert got["none"].literature_grounding_reason == "PMIDs cited but none appear in brief_text"
    assert got["none"].tier_consistency_reason == "missing priority='P2' or action=''"
    assert got["err"].signal_identification_reason == "generation_error=True" and got["err"].found
    assert got["gone"].tier_consistency_reason == "brief not found" and not got["gone"].found
    rate = rubric.pass_rate(scored).first()
    assert (rate.total, rate.passes, rate.pass_rate, rate.target_met) == (5, 1, 0.2, False)
    assert rubric.pass_rate(scored.limit(0)).first().target_met is False
    assert rows(scored.select(F.col("overall_pass")))
