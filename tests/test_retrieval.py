import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pharmasift.operators import corpus, retrieval, search_queries
from pharmasift.plans import investigation
from tests.conftest import rows

HITS = "signal_id string, query_no int, retriever string, rank int, doc_id long, score double, similarity double, distance double"


def hit(signal, q, retriever, rank, doc, similarity):
    return (signal, q, retriever, rank, doc, similarity, similarity, 1.0 - similarity)


def texts(seed, n, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(n)]


def okapi(docs, query):
    """Plain reference of the public Okapi formula with the negative-idf floor."""
    split = [t.lower().split() for t in docs]
    df = Counter(w for d in split for w in set(d))
    n, mean = len(split), sum(map(len, split)) / len(split)
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    counts = [Counter(d) for d in split]
    return [
        sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in query.lower().split())
        for c in counts
    ]


def setup_bm25(frame, n=90):
    docs = texts(5, n)
    docs[7] = docs[3]
    d = frame([(i, "hot" if i % 3 else f"g{i % 4}", t) for i, t in enumerate(docs)], "doc_id long, group_key string, text string")
    queries = [(f"s{i}", 1, "hot" if i % 2 else "g0", q) for i, q in enumerate(texts(9, 12) + ["w1 w1 W2 unknown", ""])]
    return docs, d, queries, frame(queries, "signal_id string, query_no int, group_key string, text string")


def expected_bm25(docs, queries, k=10):
    out = []
    for signal, number, group, text in queries:
        inside = [i for i in range(len(docs)) if ("hot" if i % 3 else f"g{i % 4}") == group]
        score = okapi(docs, text) if text.split() else [0.0] * len(docs)
        best = sorted((i for i in inside if score[i] >= 0.1), key=lambda i: (-round(score[i], 9), i))[:k]
        out += [(signal, number, r, i, round(score[i], 6)) for r, i in enumerate(best, start=1)]
    return sorted(out, key=str)


def test_bm25_equals_brute_force(frame):
    docs, d, queries, q = setup_bm25(frame)
    got = retrieval.bm25_topk(q, d)
    assert rows(got.select("signal_id", "query_no", "rank", "doc_id", F.round("score", 6))) == expected_bm25(docs, queries)
    assert got.filter((F.col("similarity") > 1) | (F.col("similarity") <= 0)).count() == 0


def test_stored_index_gives_the_same(spark, frame, tmp_path):
    docs, d, queries, q = setup_bm25(frame)
    retrieval.store_index(retrieval.bm25_index(d), str(tmp_path / "ix"))
    got = retrieval.bm25_topk(q, retrieval.load_index(spark, str(tmp_path / "ix")))
    assert rows(got.select("signal_id", "query_no", "rank", "doc_id", F.round("score", 6))) == expected_bm25(docs, queries)


def vectors(frame, n_docs=150, n_queries=11):
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(n_docs, 5)), rng.normal(size=(n_queries, 5))
    v[9] = v[4] * 2
    v[13] = 0
    group = ["hot" if i % 3 else "cold" for i in range(n_docs)]
    docs = frame([(i, group[i], v[i].tolist()) for i in range(n_docs)], "doc_id long, group_key string, embedding array<double>")
    queries = frame(
        [(f"s{i}", 1, "hot" if i % 2 else "cold", q[i].tolist()) for i in range(n_queries)],
        "signal_id string, query_no int, group_key string, embedding array<double>",
    )
    expected = []
    for i in range(n_queries):
        inside = [j for j in range(n_docs) if group[j] == ("hot" if i % 2 else "cold") and v[j].any()]
        sim = {j: float(q[i] @ v[j] / np.linalg.norm(q[i]) / np.linalg.norm(v[j])) for j in inside}
        best = sorted((j for j in inside if sim[j] >= 0.1), key=lambda j: (-round(sim[j], 9), j))[:4]
        expected += [(f"s{i}", r, j, round(sim[j], 6)) for r, j in enumerate(best, start=1)]
    return queries, docs, sorted(expected, key=str)


def test_dense_equals_brute_force(frame):
    queries, docs, expected = vectors(frame)
    got = retrieval.dense_topk(queries, docs, k=4, min_similarity=0.1)
    assert rows(got.select("signal_id", "rank", "doc_id", F.round("score", 6))) == expected


def test_small_blocks_change_nothing(frame, monkeypatch):
    queries, docs, expected = vectors(frame)
    monkeypatch.setattr(retrieval, "DENSE_BLOCK", (2, 7))
    monkeypatch.setattr(retrieval, "SPARSE_BLOCK", (2, 7))
    got = retrieval.dense_topk(queries, docs, k=4, min_similarity=0.1)
    assert rows(got.select("signal_id", "rank", "doc_id", F.round("score", 6))) == expected
    texts_, d, qs, q = setup_bm25(frame)
    sparse = retrieval.bm25_topk(q, d)
    assert rows(sparse.select("signal_id", "query_no", "rank", "doc_id", F.round("score", 6))) == expected_bm25(texts_, qs)


def test_fusion_prefers_shared_and_dense(frame):
    hits = frame(
        [hit("s", 1, "hnsw", 1, 10, 0.8), hit("s", 1, "hnsw", 2, 11, 0.7), hit("s", 1, "bm25", 1, 11, 0.9),
         hit("s", 1, "bm25", 2, 12, 0.3), hit("s", 2, "bm25", 1, 12, 0.5), hit("s", 2, "hnsw", 1, 11, 0.75)],
        HITS,
    )
    got = retrieval.fuse(hits).orderBy("fused_rank").collect()
    assert [r.doc_id for r in got] == [11, 12, 10]
    assert (got[0].similarity, got[0].retriever) == (0.75, "hnsw")
    assert (got[1].similarity, got[1].retriever) == (0.5, "bm25")
    assert abs(got[0].rrf_score - (1 / 62 + 1 / 61 + 1 / 61)) < 1e-15


def test_equal_fusion_scores_keep_first_appearance(frame):
    hits = frame([hit("s", 1, "bm25", 1, 2, 0.4), hit("s", 1, "hnsw", 1, 9, 0.7)], HITS)
    assert [r.doc_id for r in retrieval.fuse(hits).orderBy("fused_rank").collect()] == [9, 2]


def test_lit_score_examples(frame):
    signals = frame([("none",), ("sparse",), ("mixed",)], "signal_id string")
    hits = frame(
        [hit("sparse", 1, "bm25", n, n, 0.9) for n in range(1, 6)]
        + [hit("mixed", 1, "hnsw", 1, 1, 0.8)] + [hit("mixed", 1, "bm25", n, n, 0.9) for n in range(2, 6)],
        HITS,
    )
    got = {r.signal_id: (r.lit_score, r.n_hits) for r in retrieval.lit_scores(signals, hits).collect()}
    assert got == {"none": (0.0, 0), "sparse": (0.755, 5), "mixed": (0.86, 5)}


def test_evidence_text_and_summary(frame):
    signals = frame([("s",), ("empty",)], "signal_id string")
    fused = retrieval.fuse(frame([hit("s", 1, "hnsw", 1, 5, 0.66666), hit("s", 1, "hnsw", 2, 6, 0.6)], HITS))
    docs = frame([(5, "x" * 700), (6, "short")], "doc_id long, text string")
    got = {r.signal_id: r.evidence for r in retrieval.evidence_block(signals, fused, docs, retrieval.PUBLISHED_HEAD_CHARS).collect()}
    assert got["s"] == "[1] PMID:5 | similarity=0.667\n" + "x" * 600 + "\n\n[2] PMID:6 | similarity=0.600\nshort"
    assert got["empty"].startswith("No abstracts retrieved")
    summary = {r.signal_id: tuple(r)[1:] for r in retrieval.evidence_summary(signals, fused, 1).collect()}
    assert summary == {"s": (1, 0, 0.6667, 2), "empty": (0, 0, 0.0, 0)}


def test_query_validity(frame):
    long = ["a b c d e f", "b c d e f g", "c d e f g h"]
    cases = [
        (long, True), (long[:2], False), ([*long[:2], "too short"], False), ([long[0], long[0] + " ", long[1]], False),
        ([*long[:2], "  "], False), ([*long[:2], None], False), (None, False), ([], False),
    ]
    df = frame([(q,) for q, _ in cases], "q array<string>")
    assert [r[0] for r in df.select(search_queries.valid_queries(F.col("q"))).collect()] == [ok for _, ok in cases]


def test_query_choice_and_rows(frame):
    df = frame([("d", "p", '```json\n[" a b c d e f ", "b c d e f g", "c d e f g h"]\n```'), ("d", "q", "sorry")], "drug_key string, pt string, reply string")
    chosen = search_queries.choose_queries(df)
    got = {r.pt: (r.generated, r.search_queries[0]) for r in chosen.collect()}
    assert got == {"p": (True, "a b c d e f"), "q": (False, "d q mechanism pharmacology adverse reaction")}
    assert rows(search_queries.query_rows(chosen, ["pt"]), "pt", "query_no")[:3] == [("p", 1), ("p", 2), ("p", 3)]


def test_investigation_scores_all_signals(frame):
    queries, docs, _ = vectors(frame)
    docs = docs.withColumn("text", F.lit("w1 w2"))
    queries = queries.withColumn("text", F.lit("w1"))
    signals = frame([("d", "p", 8.0, 60, 1, 0, 0, None), ("e", "q", 1.0, 2, 0, 0, 0, 0.3)],
                    "drug_key string, pt string, prr double, drug_reaction_count long, death_count long, lt_count long, hosp_count long, stat_score double")
    assessed, hits = investigation.investigate(signals, queries.withColumn("signal_id", F.lit("d|p")).limit(1), docs, min_similarity=0.1)
    got = {r.drug_key: r for r in assessed.collect()}
    assert got["d"].stat_score == 1.0 and got["d"].n_hits == 5 and got["d"].priority == "P1"
    assert got["e"].lit_score == 0.0 and got["e"].priority == "P4" and got["e"].severity == "no serious outcomes reported"
    assert hits.count() == 5


def test_corpus_additions(frame):
    schema = "group_key string, pmid string, title string, abstract_parts array<string>, year string"
    records = frame(
        [("a", "1", "T", ["x", "y"], "2020"), ("a", "2", "T", [" "], "2020"), ("a", "3", None, ["z"], "2020"),
         ("b", "1", "T", ["x"], "2020"), ("full", "9", "T", ["x"], "2020"), ("a", "1", "T", ["x", "y"], "2020")],
        schema,
    )
    loaded = frame([("a", "3")] + [("full", str(n)) for n in range(3)], "group_key string, pmid string")
    got = corpus.new_documents(records, loaded, full=4)
    assert rows(got, "doc_key", "text") == [("a_1", "T x y"), ("b_1", "T x")]
    keys = frame([("drug_12_3",)], "k string")
    assert keys.select(corpus.pmid_of(F.col("k"))).first()[0] == "12_3"
    embedded = corpus.new_documents(records, loaded, full=4, embed=lambda t: F.array(F.length(t).cast("float")))
    assert embedded.filter(F.size("embedding") != 1).count() == 0


def test_coverage_of_expected_terms(frame):
    df = frame([("m", ["has SGLT2 word"], ["sglt2", "x"]), ("m", ["none"], ["sglt2"]), ("n", ["sglt2"], ["SGLT2"])],
               "generator string, queries array<string>, expected_terms array<string>")
    assert rows(search_queries.term_coverage(df)) == [("m", 2, 1, False), ("n", 1, 1, True)]


def test_word_blocks_get_numbers_for_words(frame):
    """Words as Python objects made a block's memory many times that of its numbers."""
    from pharmasift.operators.blocks import block_grid, blocked_topk

    q = frame([("s", 1, "g", "alpha", 2.0), ("s", 1, "g", "beta", 1.0), ("t", 1, "g", "beta", 1.0)], "signal_id string, query_no int, group_key string, term string, qtf double")
    items = frame([(1, "g", "alpha", 1.0), (2, "g", "beta", 3.0), (3, "g", "gamma", 9.0)], "doc_id long, group_key string, term string, weight double")

    def score(qs, ds):
        assert qs["term"].dtype == ds["term"].dtype == "int64"
        return retrieval.best_by_words(qs, ds, 5, 0.1)

    got = blocked_topk(q, items, block_grid(q, items, "group_key", 2, 2), "group_key", score, 5, 0, "term")
    assert rows(got.select("signal_id", "doc_id", "score", "rank")) == [("s", 1, 2.0, 2), ("s", 2, 3.0, 1), ("t", 2, 3.0, 1)]


def test_weights_of_query_words_are_computed_once(frame, monkeypatch):
    names, plain = [], retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df, name: names.append(name) or plain(df, name))
    docs, d, queries, q = setup_bm25(frame)
    retrieval.bm25_topk(q, d)
    assert names.count("weighted-words") == 1


def test_document_frequencies_are_counted_once_for_weights_and_their_mean(frame, monkeypatch):
    docs, d, queries, q = setup_bm25(frame)
    names = []
    keep = retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df, name: names.append(name) or keep(df, name))
    weights = retrieval.weighted_terms(retrieval.tokenized(d), retrieval.query_terms(q))
    assert names == ["document-frequency"]
    assert "words" not in weights._jdf.queryExecution().optimizedPlan().toString()
    assert rows(retrieval.bm25_topk(q, d).select("signal_id", "query_no", "rank", "doc_id", F.round("score", 6))) == expected_bm25(docs, queries)


def test_postings_of_large_texts_take_one_shuffle_by_document(spark, frame, monkeypatch, tmp_path):
    _, d, *_ = setup_bm25(frame)
    d.unionByName(d.limit(5)).write.parquet(str(tmp_path / "docs"))  # some ids twice
    docs = spark.read.parquet(str(tmp_path / "docs"))
    small = rows(retrieval.postings(docs))
    monkeypatch.setattr(retrieval, "SMALL_BYTES", 0)
    monkeypatch.setattr(retrieval, "spread_small", lambda df, key: df)
    large = retrieval.postings(docs)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id" in plan
    assert rows(large) == small
