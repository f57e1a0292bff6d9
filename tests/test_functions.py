import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pharmasift.functions import scores, text
from pharmasift.functions.rounding import half_even
from pharmasift.functions.vectors import cosine, term_cosine
from tests.conftest import rows


def test_half_even_equals_correct_decimal_rounding(spark, frame):
    rng = random.Random(7)
    values = [0.22415, 0.00005, 0.25, 0.35, 2.675, -0.5, -1.005, 1e9 + 0.00005, 0.0, 1.0, 1e22, -3.3e14, 2.0**60]
    values += [rng.uniform(-5, 5) for _ in range(2000)]
    values += [rng.randrange(100000) / 100000 for _ in range(4000)]
    df = frame([(v,) for v in values], "x double")
    for digits in (1, 3, 4):
        got = [r[0] for r in df.select(half_even(F.col("x"), digits)).collect()]
        assert got == [round(v, digits) for v in values]
    assert frame([(None,)], "x double").select(half_even(F.col("x"), 2)).first()[0] is None


def score(frame, *args):
    df = frame([args], "p double, a long, d long, l long, h long")
    return df.select(scores.stat_score(*[F.col(c) for c in "padlh"])).first()[0]


def test_stat_score_examples(frame):
    assert score(frame, 4.0, 50, 0, 0, 0) == 0.8
    assert score(frame, 40.0, 5000, 1, 0, 0) == 1.0
    assert score(frame, 0.0, 0, None, None, None) == 0.0
    severities = [score(frame, 4.0, 50, *o) for o in ((0, 0, 1), (0, 1, 1), (1, 0, 0))]
    assert severities == [0.9, 0.95, 1.0]


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_stat_score_range_and_monotonicity(spark, seed):
    df = spark.range(2000).select(
        (F.rand(seed) * 100).alias("p"), (F.rand(seed + 1) * 10000).cast("long").alias("a"),
        (F.rand(seed + 2) * 3).cast("long").alias("d"), (F.rand(seed + 3) * 3).cast("long").alias("l"),
        (F.rand(seed + 4) * 3).cast("long").alias("h"),
    )
    base = scores.stat_score(*[F.col(c) for c in "padlh"])
    higher = scores.stat_score(F.col("p") + 1, F.col("a"), F.col("d"), F.col("l"), F.col("h"))
    deadly = scores.stat_score(F.col("p"), F.col("a"), F.col("d") + 1, F.col("l"), F.col("h"))
    bad = df.filter(~base.between(0, 1) | (higher < base) | (deadly < base))
    assert bad.count() == 0


def test_priority_limits_are_inclusive(frame):
    df = frame([(0.7, 0.5), (0.7, 0.49), (0.69, 0.5), (0.69, 0.49)], "s double, l double")
    assert [r[0] for r in df.select(scores.priority(F.col("s"), F.col("l"))).collect()] == ["P1", "P2", "P3", "P4"]
    ranks = df.limit(1).select(*[scores.tier_rank(F.lit(t)) for t in ("P1", "P4", "P9", None)]).first()
    assert list(ranks) == [1, 4, 5, 5]


def test_action_normalization(frame):
    cases = {
        "monitor": "MONITOR", " Label_Update ": "LABEL_UPDATE", "": "MONITOR", None: "MONITOR",
        "MONITOR OR LABEL_UPDATE OR RESTRICT": "MONITOR", "RESTRICT FOR PATIENTS AT RISK": "MONITOR",
        "remove it": "WITHDRAW", "limit use": "RESTRICT", "revise text": "LABEL_UPDATE",
        "no idea": "MONITOR", "WITHDRAW": "WITHDRAW",
    }
    df = frame([(k,) for k in cases], "a string")
    assert [r[0] for r in df.select(scores.normalize_action(F.col("a"))).collect()] == list(cases.values())


def test_outcome_texts_and_hints(frame):
    df = frame([(2, 1, 3, 11.0), (0, 0, 0, 3.0), (1, 0, 0, 2.5), (0, 2, 0, 2.5), (0, 0, 4, 9.0)], "d int, l int, h int, p double")
    got = df.select(
        scores.outcome_text(F.col("d"), F.col("l"), F.col("h")), scores.outcome_line(F.col("d"), F.col("l"), F.col("h")),
        scores.action_hint(F.col("d"), F.col("l"), F.col("h"), F.col("p")),
    ).collect()
    assert got[0][0] == "2 deaths, 1 life-threatening, 3 hospitalisations"
    assert got[1][0] == "no serious outcomes reported"
    assert got[1][1] == "Serious outcomes: none reported"
    assert "WITHDRAW criteria" in got[0][2] and "11.00 > 10" in got[0][2]
    assert got[1][2].startswith("ℹ No serious") and "limited to specific" in got[2][2]
    assert "life-threatening events with PRR 2.50" in got[3][2] and got[4][2] == ""


def test_citation_ids_lose_label_characters(frame):
    df = frame([(" PMID: 123 ",), ("123",), ("DIM:77",), ("PMID:PMID:5",)], "p string")
    assert [r[0] for r in df.select(scores.bare_citation_id(F.col("p"))).collect()] == ["123", "123", "77", "5"]


def test_percent_and_bands(frame):
    df = frame([(1, 3), (1, 0), (0, 5), (2, None)], "a int, b int")
    assert [r[0] for r in df.select(scores.percent(F.col("a"), F.col("b"))).collect()] == [33.3, 0.0, 0.0, 0.0]
    bands = frame([(0.7,), (0.5,), (0.3,), (0.29,)], "s double")
    assert rows(bands.select(scores.stat_band(F.col("s")), scores.lit_band(F.col("s")))) == sorted(
        [("high", "high"), ("medium", "high"), ("low", "medium"), ("low", "low")]
    )


def test_tokens_equal_python_split(frame):
    samples = ["A b\tC\n d", "  lead and trail  x y　z ", "a\x1cb\x1fc\x85d\x0be", "", "   ", "one", "Straße ÉCLAIR"]
    df = frame([(s,) for s in samples], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [s.lower().split() for s in samples]
    assert [r[0] for r in df.select(text.strip(F.col("t"))).collect()] == [s.strip() for s in samples]
    assert frame([(None,)], "t string").select(text.tokens(F.col("t"))).first()[0] == []


def test_json_replies(frame):
    replies = ['```json\n["a", "b"]\n```', '```["a"]```', '["a", 1]', "no", '{"a": 1}', "[]", None]
    df = frame([(r,) for r in replies], "r string")
    got = [r[0] for r in df.select(text.json_strings(text.unfence(F.col("r")))).collect()]
    assert got == [["a", "b"], ["a"], None, None, None, [], None]
    arrays = frame([('["x"]',), ("broken",), (None,)], "r string")
    assert [r[0] for r in arrays.select(text.json_array_or_empty(F.col("r"))).collect()] == [["x"], [], []]


def test_name_expressions(frame):
    df = frame([("acetaminophen \\hydrocodone",), ("plain",), (None,)], "n string")
    assert [r[0] for r in df.select(text.name_join_key(F.col("n"))).collect()] == ["ACETAMINOPHEN", "PLAIN", None]


def test_cosines(frame):
    df = frame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1] is None
    words = frame([(["x", "x", "y"], ["x", "z"])], "a array<string>, b array<string>")
    assert abs(words.select(term_cosine(F.col("a"), F.col("b"))).first()[0] - 2 / (5**0.5 * 2**0.5)) < 1e-12
