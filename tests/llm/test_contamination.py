"""Containment against brute force."""

import random

import pytest
import regex

from pharmasift.llm import contamination


def grams(text, k=5):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    out = {}
    for d, t in docs:
        g = set().union(*(grams(t, k) for k in range(1, 6)))
        for i, u in items:
            n = len(regex.findall(r"[\p{L}\p{N}]+", u or ""))
            s = grams(u, min(n, 5)) if n else set()
            if s and 100 * len(s & g) >= 80 * len(s):
                out[d, i, len(s)] = max(len(s & g), out.get((d, i, len(s)), 0))
    return sorted(((*k, v) for k, v in out.items()), key=str)


def table(seed):
    draw = random.Random(seed)
    word = [f"w{i}" for i in range(60)]
    text = lambda n: [draw.choice(word) for _ in range(n)]
    items = [text(draw.choice([5, 6, 12, 30, 80])) for _ in range(40)]
    docs = []
    for n in range(150):
        d = text(draw.choice([3, 40, 400]))
        for _ in range(draw.choice([0, 1, 3])):
            copy = list(draw.choice(items))
            for _ in range(draw.choice([0, 0, 1, 2, 6])):
                copy[draw.randrange(len(copy))] = "changed"
            d[draw.randrange(len(d) + 1) : 0] = copy
        docs.append((n, draw.choice([" ", "!! ", " | ", "\n"]).join(d).upper() if n % 7 == 0 else " ".join(d)))
    docs += [(500, None), (501, ""), (502, "w1 w2"), (3, docs[3][1]), (4, " ".join(items[0])), (503, "Élan ÉTÉ ça où naïve fin"), (None, " ".join(items[1]))]
    pool = [(n, " ".join(x)) for n, x in enumerate(items)]
    pool += [(90, None), (91, ""), (92, "w1 w2 w3 w4"), (93, "élan, été: ça où naïve"), (0, pool[0][1]), (1, pool[5][1]), (None, pool[6][1])]
    return docs, pool


@pytest.mark.parametrize("seed, rows", [(0, None), (1, None), (2, 0)])
def test_like_brute_force(spark, as_list, monkeypatch, seed, rows):
    if rows is not None:  # every look-up is shuffled
        monkeypatch.setattr(contamination, "small", lambda df: False)
    docs, items = table(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS item", "3 AS version")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n")
    assert as_list(contamination.contained(d, i)) == brute(docs, items)


def test_short_items(spark, as_list):
    """Items of one to four words match where all their words follow each other."""
    docs = [(1, "What is it? Yes, it is so."), (2, "is so it"), (3, "yes"), (4, "no"), (5, None), (6, "a b c d"), (7, "a b c x d e")]
    items = [(1, "it is so"), (2, "YES!"), (3, "a b c d"), (4, "..."), (5, "b c"), (6, "a b c d e")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = as_list(contamination.contained(d, i))
    assert found == brute(docs, items)
    assert {(r[0], r[1]) for r in found} == {(1, 1), (1, 2), (3, 2), (6, 3), (6, 5), (7, 5)}


def test_nothing(spark):
    docs, items = table(3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert contamination.contained(d.limit(0), i).collect() == []
    assert contamination.contained(d, i.limit(0)).collect() == []
