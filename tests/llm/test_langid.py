"""Language identification: held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest

from pharmasift.llm import langid

DIR = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DIR)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.identify(docs).collect()
    assert len(found) == len(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_labels_ids_and_sources_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(DIR)
    other = docs.withColumn("lang", langid.F.when(langid.held_out(docs.doc_id), "xx").otherwise(docs.lang)).withColumn("source", langid.F.lit("?"))
    assert sorted(langid.identify(docs).collect()) == sorted(langid.identify(other).collect())


def test_odd_rows(spark):
    rows = [(1, "the dog and the cat", "en"), (3, "der hund und die katze", "de"), (4, "the the the", "en"), (7, "und und", "de"),
            (5, None, "en"), (8, "12 !?", None), (9, "", "de"), (10, "\U00010330", None), (None, "the", None), (4, "the the the", "en"), (11, "the dog " * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS _text")
    found = {}
    for r in langid.identify(docs).collect():
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score > 0))
    assert found[5] == found[8] == found[9] == [("und", False)]
    assert found[10][0][0] in ("en", "de") and found[None] == [("en", True)] and found[11] == [("en", True)]
    assert len(found[4]) == 2
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.drop("lang").withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_one_text_does_not_change_another():
    grams = langid.Grams()
    alone = grams.of(["abc é"], [0])[0]
    both, starts, letters = grams.of(["xyz", "abc é"], [0, 0])
    assert np.array_equal(both[starts[1] :], alone) and list(letters) == [3, 4]


def plain_grams(text, grams):
    """Bucket counts of a whole text, one n-gram at a time."""
    codes = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    found = {}
    for order in langid.ORDERS:
        factors = [int(f) for f in grams.factors[order]]
        for i in range(len(codes)):
            window = (codes[i : i + order] + [0] * order)[:order]
            if any(window):
                h = order
                for c, f in zip(window, factors):
                    h = (h + c * f) & 0xFFFFFFFF
                h ^= h >> 15
                h = h * 0x2C1B3C6D & 0xFFFFFFFF
                h ^= h >> 13
                b = h % langid.BUCKETS
                found[b] = found.get(b, 0) + 1
    return found


def test_like_a_plain_naive_bayes(spark):
    """Counts, log-probabilities and posteriors written out for every document of the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows, grams = docs.collect(), langid.Grams()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    features = {r.doc_id: plain_grams(r.text or "", grams) for r in rows}
    counts, sizes = {}, {}
    for r in rows:
        if not held[r.doc_id] and r.text is not None and r.lang is not None:
            own = counts.setdefault(r.lang, {})
            sizes[r.lang] = sizes.get(r.lang, 0) + 1
            for b, n in features[r.doc_id].items():
                own[b] = own.get(b, 0) + n
    totals = {l: sum(c.values()) + langid.ALPHA * langid.BUCKETS for l, c in counts.items()}
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    for d, own in features.items():
        if not own:
            assert (found[d].lang_pred, found[d].score) == ("und", 0.0)
            continue
        logs = {
            l: np.log(sizes[l] / sum(sizes.values())) + sum(n * np.log((c.get(b, 0) + langid.ALPHA) / totals[l]) for b, n in own.items())
            for l, c in counts.items()
        }
        best = max(logs, key=logs.get)
        chance = 1 / sum(np.exp(x - logs[best]) for x in logs.values())
        assert found[d].lang_pred == best and found[d].score == pytest.approx(chance, abs=1e-6)


@pytest.mark.parametrize("limit", [1, 2, 7, 1000])
def test_cuts_of_long_texts_change_nothing(limit):
    grams, text = langid.Grams(), "Straße ÉTÉ, ΑΣ. the İx 12 日本 \U00010330!"
    whole = np.bincount(grams.of([text.lower()], [0])[0].ravel(), minlength=langid.BUCKETS + 1)[: langid.BUCKETS]
    cut, letters = np.zeros_like(whole), 0
    for group in langid.grouped([(0, text)], 3, limit):
        found, _, some = grams.of([t for _, t, _ in group], [more for *_, more in group])
        cut += np.bincount(found.ravel(), minlength=langid.BUCKETS + 1)[: langid.BUCKETS]
        letters += some.sum()
    assert np.array_equal(whole, cut) and letters == sum(c.isalpha() for c in text.lower())
