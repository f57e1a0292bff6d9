"""The quality classifier against the given labels, and odd rows."""

import pytest

from pharmasift.llm import quality

DIR = "/root/testdata/sf0.01"


def test_against_labels(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    found = quality.classify(docs, labels)
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [r.kept for r in rows if r.toxic == 1]
    low = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean)
    assert sum(toxic) <= 0.1 * len(toxic) and sum(low) <= 0.08 * len(low)


def test_label_model_finds_accuracies():
    import random

    draw, patterns = random.Random(1), {}
    rates = [(0.9, 0.02), (0.7, 0.05), (0.8, 0.01)]
    names = quality.FAMILIES["shouting"]
    for _ in range(20_000):
        bad = draw.random() < 0.2
        vote = [0] * len(quality.LABELLERS)
        for k, (hit, alarm) in enumerate(rates):
            j = quality.LABELLERS.index(names[k])
            vote[j] = -1 if draw.random() < 0.1 else int(draw.random() < (hit if bad else alarm))
        patterns[tuple(vote)] = patterns.get(tuple(vote), 0) + 1
    model = quality.fit_labels(patterns)
    assert model.prior["shouting"] == pytest.approx(0.2, abs=0.03)
    for k, (hit, alarm) in enumerate(rates):
        j = quality.LABELLERS.index(names[k])
        assert model.hit[j] == pytest.approx(hit, abs=0.05) and model.alarm[j] == pytest.approx(alarm, abs=0.02)


GOOD = "The river was high and the old bridge at the mill had been closed for most of the week, so we walked. "


def test_odd_rows(spark):
    bad = ["BUY THIS NOW!! CHEAP!! OFFER!! " * 9, "one### two%%% three&&& four$$$ " * 9, "home | about | news | login | " * 9, "again again again again again " * 20]
    rows = [(n, t) for n, t in enumerate([*bad, None, "", " ", "a", GOOD, GOOD * 3000, "!", "\x00", *(f"{GOOD} {i} birds" for i in range(60))])]
    rows += [(8, GOOD), (None, GOOD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS reject_score", "2 AS kept", "3 AS _text")
    labels = spark.createDataFrame([(12, 1, 0), (12, 1, 0), (13, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(rows)
    kept = {r.doc_id: r.kept for r in found}
    assert not any(kept[n] for n in range(4)) and all(k for i, k in kept.items() if i is None or i >= 4 and i != 9)
    assert quality.classify(docs.limit(0), labels.limit(0)).collect() == []
    with pytest.raises(ValueError):
        quality.score(docs, None)


def test_equal_texts_with_different_labels_count_as_toxic(spark):
    """The label of a repeated text is the higher one, however its rows are spread."""
    import random

    draw = random.Random(2)
    texts = [" ".join(draw.choices("aaa bbb ccc ddd eee".split(), k=40)) for _ in range(60)]
    bad = [t + " xqzvile" * 6 for t in texts[:20]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(bad)] + [(200 + i, t) for i, t in enumerate(bad)]
    labels = [(i, 0) for i in range(60)] + [(100 + i, i % 2) for i in range(20)] + [(200 + i, 1 - i % 2) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = quality.learn_terms(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("xqzvile".startswith(t) for weights in found.weights for t in weights)
