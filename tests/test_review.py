from datetime import date, datetime

from pyspark.sql import functions as F

from pharmasift.operators import evaluate, ledger, quality, review
from tests.conftest import rows

SIGNAL = "drug_key string, pt string, prr double, stat_score double, drug_reaction_count long, death_count long, hosp_count long, lt_count long"
BRIEF = "brief_id long, drug_key string, pt string, stat_score double, lit_score double, priority string, recommended_action string, brief_text string, generation_error boolean, generated_at string, input_tokens long, output_tokens long"
DECISION = "drug_key string, pt string, decision string, reviewer_note string, decided_at timestamp"


def t(n):
    return datetime(2024, 1, n)


def tables(frame):
    signals = frame(
        [("a", "x", 3.0, 0.9, 60, 1, 0, 0), ("a_b", "y", 9.0, 0.5, 70, None, 0, 0), ("c", "z", 5.0, None, 50, 4, 0, 0), ("d", "w", 2.0, 0.4, 55, 0, 0, 0)],
        SIGNAL,
    )
    briefs = frame(
        [(1, "a", "x", 0.9, 0.6, "P1", "MONITOR", "t", False, "g", 100, 10), (2, "a_b", "y", 0.5, 0.0, "P4", "MONITOR", "t", False, "g", 50, 5),
         (3, "c", "z", None, None, None, None, None, True, "g", None, None)],
        BRIEF,
    )
    decisions = frame(
        [("a", "x", "REJECT", None, t(1)), ("a", "x", "APPROVE", "n", t(3)), ("a", "x", "REJECT", None, t(2)), ("gone", "x", "REJECT", None, None)],
        DECISION,
    )
    return signals, briefs, decisions


def test_feed_order_search_and_pages(frame):
    feed = review.feed_rows(*tables(frame))
    assert {r.drug_key: r.hitl_decision for r in feed.collect()} == {"a": "APPROVE", "a_b": None, "c": None, "d": None}
    assert [r.drug_key for r in review.feed_page(feed).collect()] == ["a", "a_b", "c", "d"]
    assert [r.drug_key for r in review.feed_page(feed, 2, 1).collect()] == ["a_b", "c"]
    assert [r.drug_key for r in review.order_feed(feed, "deaths").collect()] == ["c", "a", "a_b", "d"]
    assert [r.drug_key for r in review.order_feed(feed, "cases").collect()] == ["a_b", "a", "d", "c"]
    assert rows(review.filter_feed(feed, search="A_B"), "drug_key") == [("a_b",)]
    assert rows(review.filter_feed(feed, search="%"), "drug_key") == []
    assert rows(review.filter_feed(feed, priority="P1"), "drug_key") == [("a",)]


def test_queue_and_counters(frame):
    signals, briefs, decisions = tables(frame)
    assert [r.drug_key for r in review.queue(signals, briefs, decisions).collect()] == ["a_b"]
    assert review.pending_briefs(briefs, decisions).first()[0] == 1
    assert tuple(review.signal_gauges(signals, decisions).first()) == (4, 3)
    assert tuple(review.feed_counts(signals, briefs).first()) == (4, 1, 0, 0, 1, 2)
    assert tuple(review.table_counts(signals, briefs, decisions).first()) == (4, 2, 4)
    assert [r.decided_at for r in review.history(decisions).collect()] == [t(3), t(2), t(1), None]
    m = review.run_metrics(briefs).first()
    assert (m.total_runs, m.tokens_in, m.tokens_out, m.avg_lit_score, m.zero_lit_runs, m.generation_errors) == (3, 150, 15, 0.3, 1, 1)
    empty = review.run_metrics(briefs.limit(0)).first()
    assert (empty.total_runs, empty.tokens_in, empty.avg_lit_score, empty.estimated_cost) == (0, 0, 0.0, 0.0)
    cover = review.coverage(
        review.table_counts(signals, briefs, decisions), review.tier_distribution(briefs),
        review.decision_breakdown(decisions), review.pending_briefs(briefs, decisions),
    ).first()
    assert (cover.brief_coverage, cover.p1_share, cover.p2_share, cover.approve_share, cover.pending_share) == (50.0, 50.0, 0.0, 25.0, 20.0)


def test_investigated_split(frame):
    signals, briefs, decisions = tables(frame)
    feed = review.feed_rows(signals, briefs, decisions)
    assert [r.drug_key for r in review.investigated(feed).collect()] == ["a", "a_b"]
    assert [r.drug_key for r in review.uninvestigated(feed).collect()] == ["c", "d"]
    pending = frame([("c", "z")], "drug_key string, pt string")
    assert [r.drug_key for r in review.uninvestigated(feed, pending).collect()] == ["d"]


def test_detail_and_lists(frame):
    signals, briefs, _ = tables(frame)
    assert review.brief_detail(signals, briefs, "a", "x").first().brief_id == 1
    assert review.brief_detail(signals, briefs, "a", "nope").count() == 0
    drugs = frame([("c",), ("a_b",), (None,)], "drug_key string")
    assert [(r.drug_key, r.death_count) for r in review.in_list(signals, drugs).collect()] == [("a_b", 0), ("c", 4)]
    assert rows(review.reactions_per_drug(signals.unionByName(signals)))[0] == ("a", ["x"])


def leads(frame, days):
    return frame([("d", f"p{i}", date(2024, 1, 1), d, True) for i, d in enumerate(days)],
                 "drug_key string, pt string, comm_date date, lead_time_days int, flagged boolean")


def test_upper_median(frame):
    for days, expected in (([100, 200, 300, 400], 300), ([5, 1, 9], 5), ([7], 7), ([3, 3, 1, 1], 3), ([None, 2, 4], 4), ([], None)):
        assert evaluate.lead_summary(leads(frame, days)).first().median_lead_time == expected
    assert evaluate.lead_summary(leads(frame, [0, 5, -1, None])).first().positive_detections == 1


def test_golden_evaluation(frame):
    golden = frame([("a", "x", date(2023, 4, 15), "l"), ("b", "y", None, "l"), ("c", "z", date(2023, 1, 1), "l")],
                   "drug_key string, pt string, comm_date date, comm_label string")
    pairs = frame([("a", "x", date(2023, 1, 5)), ("a", "x", date(2023, 2, 5)), ("c", "z", date(2023, 3, 1)), ("a", "x", None)],
                  "drug_key string, pt string, fda_dt date")
    signals = frame([("a", "x", 2.0, 50, 0.8), ("c", "z", 1.9, 50, 0.1)], "drug_key string, pt string, prr double, drug_reaction_count long, stat_score double")
    table = evaluate.with_lead_class(evaluate.lead_times(golden, pairs, signals, 2.0, 50))
    assert rows(table, "drug_key", "lead_time_days", "flagged", "lead_class") == [
        ("a", 100, True, "before_notice"), ("b", None, False, "not_detected"), ("c", -59, False, "not_flagged")
    ]
    s = evaluate.summary(table).first()
    assert (s.total_golden, s.flagged, s.not_flagged, s.precision, s.precision_denominator, s.median_lead_time) == (3, 1, 1, 0.5, 2, 100)
    p = evaluate.precision(evaluate.golden_breakdown(golden, signals, 2.0, 50)).first()
    assert (p.precision, p.golden_recall, p.not_flagged) == (0.5, 0.5, 1)


def test_quality_checks(frame):
    pairs = frame([(1, "a", "x"), (1, "a", "x"), (2, None, "x"), (3, "B", "Y")], "primaryid long, drug_key string, pt string")
    assert [quality.row_range(pairs, lo, hi).first().verdict for lo, hi in ((5, 9), (1, 3), (4, 4))] == ["low", "high", "ok"]
    need = frame([("a", "x"), ("z", "x")], "drug_key string, pt string")
    assert rows(quality.required_pairs(pairs, need)) == [("a", "x", 2, True), ("z", "x", 0, False)]
    assert rows(quality.required_signals(pairs, [("b", "y"), ("q", "x")]), "ok") == [(False,), (True,)]
    assert tuple(quality.readiness(pairs).first()) == (4, 1, 1, 1, 1)
    assert tuple(quality.readiness(pairs.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert rows(quality.present_columns(pairs, ["pt", "nope", "drug_key"])) == [("drug_key", True, 3), ("nope", False, 0), ("pt", True, 4)]
    good, bad = quality.split_valid(pairs, [("drug given", F.col("drug_key").isNotNull()), ("id small", F.col("primaryid") < 3)])
    assert good.count() == 2 and rows(bad, "violations") == [(["drug given"],), (["id small"],)]


def test_ledger(frame):
    calls = frame([(i, date(2024, 1, 1 + i % 2), "q" if i % 3 else "b", 1000 * i, i) for i in range(50)],
                  "call_id long, day date, task string, input_tokens long, output_tokens long")
    got = {r.task: r for r in ledger.usage_by_task(calls).collect()}
    assert got["q"].total_calls == 33 and got["b"].total_tokens == sum(1001 * i for i in range(0, 50, 3))
    assert rows(ledger.running_spend(calls, "0.05", runs=7)) == rows(ledger.running_spend(calls, "0.05"))
    final = {r.day: r.spent for r in ledger.spend_by_day(calls).collect()}
    running = ledger.running_spend(calls, "0.05", runs=7).groupBy("day").agg(F.max("spent").alias("m"))
    assert {r.day: r.m for r in running.collect()} == final
    texts = calls.withColumn("call_id", F.concat(F.lit("c"), F.lpad(F.col("call_id").cast("string"), 3, "0"))).withColumn("ts", F.lit("same"))
    for order in (("call_id",), ("ts", "call_id")):  # any type, and many calls of one time
        got = ledger.running_spend(texts, "0.05", order=order, runs=7)
        assert [r.spent for r in got.orderBy("call_id").collect()] == [r.spent for r in ledger.running_spend(calls, "0.05").orderBy("call_id").collect()]
    assert ledger.running_spend(calls.limit(0)).count() == 0
    dear = {r.day: r.spent for r in ledger.spend_by_day(calls, prices={"q": ("1", "1"), "b": ("1", "1")}).collect()}
    assert all(dear[day] > 100 * spent for day, spent in final.items())
    one = ledger.with_cost(frame([(1, 7)], "input_tokens long, output_tokens long")).first().cost
    assert str(one) == "0.00000435"
