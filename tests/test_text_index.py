"""Segmented BM25 index against the plain formula."""

import glob
import os
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pharmasift.operators import retrieval, text_index
from pharmasift.operators.text_index import TextIndex, write_segment
from tests.conftest import rows
from tests.test_retrieval import expected_bm25, setup_bm25


@pytest.fixture(scope="module", autouse=True)
def few_buckets():
    """Small tables needn't have many files."""
    before, text_index.BUCKETS = text_index.BUCKETS, 4
    yield
    text_index.BUCKETS = before


def found(queries, index, **options):
    got = retrieval.bm25_topk(queries, index, **options)
    return rows(got.select("signal_id", "query_no", "rank", "doc_id", F.round("score", 6)))


@pytest.fixture(scope="module")
def grown(spark, frame, tmp_path_factory):
    """Three segments of very small blocks; their tables before and after additions and a merge."""
    docs, d, queries, q = setup_bm25(frame, 240)
    root = tmp_path_factory.mktemp("ix")
    part = [d.where(f"doc_id % 3 = {i}") for i in range(3)]
    first = TextIndex(spark, (write_segment(part[0], f"{root}/s0", block_docs=5),))
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/s0/**/*.parquet", recursive=True)}
    full = first.add(part[1], f"{root}/s1", block_docs=5).add(part[2], f"{root}/s2", block_docs=5)
    return docs, d, queries, q, root, files, first, full


def test_segments_equal_an_index_built_at_once(grown):
    docs, _, queries, q, _, _, _, full = grown
    assert found(q, full) == expected_bm25(docs, queries)
    assert found(q, full, k=3) == expected_bm25(docs, queries, k=3)


def test_old_segments_stay_and_split_texts_are_not_read_again(grown):
    *_, root, files, first, full = grown
    now = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/s0/**/*.parquet", recursive=True)}
    assert now == files and full.segments[0] == first.segments[0]


def test_merged_segments(grown, spark):
    docs, _, queries, q, root, files, _, full = grown
    merged = full.merge(full.segments[1:], f"{root}/m", block_docs=7)
    assert len(merged.segments) == 2 and merged.segments[0] == full.segments[0]
    assert found(q, merged) == expected_bm25(docs, queries)
    assert spark.read.parquet(f"{root}/m/postings").count() == full.table("postings").where("segment > 0").count()


def test_statistics_are_sums_over_segments(grown):
    _, d, *_, full = grown
    whole = {r.term: r.df for r in retrieval.document_frequency(d).collect()}
    assert {r.term: r.df for r in full.frequencies().collect()} == whole
    stats = retrieval.corpus_stats(d).first()
    assert full.lengths == (stats.n_docs, pytest.approx(stats.mean_tokens))


def test_bounds_hold_and_blocks_are_bounded(grown):
    *_, full = grown
    reached = full.table("postings").groupBy("segment", "term", "group_key", "block").agg(
        F.max(full.saturation(F.col("tf"), F.col("n_tokens"))).alias("best"), F.count("*").alias("n")
    )
    b = full.table("blocks")
    both = b.join(reached, ["segment", "term", "group_key", "block"])
    assert both.count() == b.count() == reached.count()
    assert both.where(full.saturation(F.col("max_tf"), F.col("min_tokens")) < F.col("best") - 1e-12).count() == 0
    assert reached.agg(F.max("n")).first()[0] <= 20  # five, spread by hash


def test_blocks_that_cannot_win_are_not_scored(grown, monkeypatch):
    """The second pass gets fewer blocks than there are bounds, and a threshold of all documents gets them all."""
    *_, q, _, _, _, full = grown
    seen = []
    scored = TextIndex._scored

    def spy(self, chosen, *rest):
        seen.append(chosen.count())
        return scored(self, chosen, *rest)

    monkeypatch.setattr(TextIndex, "_scored", spy)
    found(q, full, k=1)
    pruned = sum(seen)
    seen.clear()
    found(q, full, k=10_000)
    assert pruned < sum(seen)


def test_postings_of_the_segments_are_read_once(grown, monkeypatch):
    docs, _, queries, q, *_, full = grown
    seen = []
    table = TextIndex.table
    monkeypatch.setattr(TextIndex, "table", lambda self, name: seen.append(name) or table(self, name))
    assert found(q, full) == expected_bm25(docs, queries)
    assert seen.count("postings") == 1


def test_few_words_read_few_files(grown, frame):
    *_, root, _, _, full = grown
    few = frame([("s", 1, "hot", "w1")], "signal_id string, query_no int, group_key string, text string")
    words = full.weighted(retrieval.query_terms(few))
    buckets = [r[0] for r in words.select(text_index.bucket(F.col("term"))).distinct().collect()]
    read = full.table("postings").where(F.col("bucket").isin(buckets))
    assert len(buckets) == 1
    assert len({r[0] for r in full.table("postings").select(F.input_file_name()).distinct().collect()}) > 2 * len(full.segments)
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in scan or "bucket" in scan.split("PartitionFilters")[1][:60]
    names = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(names) <= len(full.segments)


def test_null_and_empty_texts_repeated_rows_and_no_documents(spark, frame, tmp_path):
    schema = "doc_id long, group_key string, text string, block int, bucket int"
    d = frame([(1, "g", None, 1, 1), (2, "g", "", 1, 1), (3, "g", "a b a", 1, 1), (4, "g", "b", 1, 1), (5, "g", "c", 2, 2), (6, None, "a", 3, 3)], schema)
    q = frame([("s", 1, "g", "a b"), ("t", 1, "g", "zz"), ("u", 1, "none", "a")], "signal_id string, query_no int, group_key string, text string")
    index = TextIndex(spark, (write_segment(d, str(tmp_path / "a")),))
    assert index.lengths == (6, 1.0)
    assert [(r[0], r[3]) for r in found(q, index)] == [("s", 3), ("s", 4)]
    empty = TextIndex(spark, (write_segment(d.limit(0), str(tmp_path / "e")),))
    assert found(q, empty) == []
    assert found(q, empty.add(d, str(tmp_path / "b"))) == found(q, index)


def test_segments_are_united_without_their_texts(spark, frame, tmp_path):
    """Also with rows that share an id, in one segment and in two, and rows without a group or an id."""
    schema = "doc_id long, group_key string, text string"
    old = [(1, "g", "b a b"), (1, "g", "a c c"), (2, "g", "a"), (None, "g", "a d"), (3, None, "d e")]
    new = [(1, "g", "c b a"), (None, "g", "d d"), (4, "g", None), (5, None, "d")]
    q = frame([("s", 1, "g", "a b c"), ("t", 1, "g", "d e")], "signal_id string, query_no int, group_key string, text string")
    paths = [write_segment(frame(part, schema), str(tmp_path / name)) for part, name in ((old, "old"), (new, "new"))]
    for path in paths:
        shutil.rmtree(f"{path}/words", ignore_errors=True)
    merged = TextIndex(spark, tuple(paths)).merge(paths, str(tmp_path / "merged"))
    once = TextIndex(spark, (write_segment(frame(old + new, schema), str(tmp_path / "once")),))
    columns = ["group_key", "doc_id", "n_tokens", "term", "tf"]
    got = rows(merged.table("postings").select(columns))
    assert got == rows(once.table("postings").select(columns))
    assert ("g", 1, 3, "b", 3) in got and ("g", 1, 3, "c", 3) in got and ("g", None, 2, "d", 3) in got
    assert rows(merged.table("blocks")) == rows(once.table("blocks"))
    assert merged.lengths == once.lengths == (9, pytest.approx(17 / 9))
    assert {r.term: r.df for r in merged.frequencies().collect()} == {"a": 3, "b": 1, "c": 1, "d": 3, "e": 1}
    assert found(q, merged, min_score=-10.0) == found(q, once, min_score=-10.0)


def test_words_of_a_row_are_counted(frame):
    texts = ["b a b", "", "x", "\u00e9 e \u00e9 E", "z " * 50 + "y"]
    split = retrieval.tokenized(frame([(i, "g", t) for i, t in enumerate(texts)], "doc_id long, group_key string, text string"))
    got = {r.doc_id: {t.term: t.tf for t in r.terms} for r in text_index.counted_words(split).collect()}
    assert got == {i: dict(Counter(t.lower().split())) for i, t in enumerate(texts)}


def test_blocks_of_a_bucket_are_divided_into_files(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "FILE_POSTINGS", 25)
    d = frame([(i, "g", " ".join(f"w{i}_{j}" for j in range(10))) for i in range(20)], "doc_id long, group_key string, text string")
    index = TextIndex(spark, (write_segment(d, str(tmp_path / "a")),))
    for name in ("postings", "blocks", "terms"):
        files = index.table(name).select("bucket", F.input_file_name().alias("file")).distinct().groupBy("bucket").count()
        assert {r["count"] for r in files.collect()} == {2}, name


def test_search_shuffles_no_posting_or_block_that_nobody_asks_for(grown, spark):
    docs, _, queries, q, _, _, _, full = grown
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = retrieval.bm25_topk(q, full)
        assert "SortMergeJoin [group_key" not in plan(got) and "SortMergeJoin [segment" not in plan(got)
        assert rows(got.select("signal_id", "query_no", "rank", "doc_id", F.round("score", 6))) == expected_bm25(docs, queries)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
