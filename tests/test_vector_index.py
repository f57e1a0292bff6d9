"""Inverted-file vector index: exact in full, recall with few cells, pruning, additions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pharmasift.operators import retrieval, vector_index
from pharmasift.operators.vector_index import VectorIndex
from tests.conftest import rows
from tests.test_retrieval import vectors


def picked(df):
    return rows(df.select("signal_id", "rank", "doc_id", F.round("score", 6)))


def test_all_cells_equal_brute_force(frame, tmp_path):
    queries, docs, expected = vectors(frame)
    index = VectorIndex.build(docs, str(tmp_path / "v"), cells=9)
    assert len(index.centres) == 9
    got = retrieval.dense_topk(queries, index, k=4, min_similarity=0.1, probes=None)
    assert picked(got) == expected
    assert got.columns == retrieval.dense_topk(queries, docs, k=4, min_similarity=0.1).columns


def test_small_blocks_and_reloading_change_nothing(spark, frame, tmp_path, monkeypatch):
    queries, docs, expected = vectors(frame)
    VectorIndex.build(docs.where("doc_id < 60"), str(tmp_path / "v"), cells=5).add(docs.where("doc_id >= 60"))
    monkeypatch.setattr(vector_index, "CELL_ROWS", 3)
    index = VectorIndex.load(spark, str(tmp_path / "v"))
    assert picked(retrieval.dense_topk(queries, index, k=4, min_similarity=0.1, probes=None)) == expected


@pytest.fixture(scope="module")
def clustered(frame, tmp_path_factory):
    """4000 vectors around 40 centres, 100 queries near vectors of the table."""
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 16))
    m = centres[draw.integers(40, size=4000)] + 0.5 * draw.normal(size=(4000, 16))
    q = m[draw.integers(4000, size=100)] + 0.2 * draw.normal(size=(100, 16))
    docs = frame([(i, "g", v.tolist()) for i, v in enumerate(m)], "doc_id long, group_key string, embedding array<double>")
    queries = frame([(f"s{i}", 1, "g", v.tolist()) for i, v in enumerate(q)], "signal_id string, query_no int, group_key string, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    best = {f"s{i}": set(np.argsort(-(unit @ v))[:10].tolist()) for i, v in enumerate(q)}
    index = VectorIndex.build(docs, str(tmp_path_factory.mktemp("v") / "v"), sample=1000)
    return docs, queries, best, index


def test_recall_at_ten_with_few_cells(clustered):
    docs, queries, best, index = clustered
    assert len(index.centres) > 40 and index.vectors().count() == 4000
    found = {}
    for r in index.topk(queries, 10, -1.0, probes=8).collect():
        found.setdefault(r.signal_id, set()).add(r.doc_id)
    recall = sum(len(found.get(s, set()) & b) for s, b in best.items()) / (10 * len(best))
    assert recall >= 0.9


def test_only_asked_cells_are_read(clustered):
    _, queries, _, index = clustered
    one = queries.limit(1)
    cells = {r.cell for r in vector_index._cells(one.select("signal_id", "embedding"), index.centres, 3).collect()}
    read = index.vectors().where(F.col("cell").isin(list(cells)))
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "cell" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert len(cells) == 3 and read.count() < 4000 / 5


def test_null_zero_and_no_vectors(spark, frame, tmp_path):
    schema = "doc_id long, group_key string, embedding array<double>, cell int"
    docs = frame([(1, "g", [1.0, 0.0], 7), (2, "g", None, 7), (3, "g", [0.0, 0.0], 7), (4, None, [1.0, 0.0], 7), (5, "h", [1.0, 0.1], 7), (1, "g", [1.0, 0.0], 7)], schema)
    q = frame([("s", 1, "g", [1.0, 0.0]), ("t", 1, "g", None), ("u", 1, "g", [0.0, 0.0]), ("v", 1, None, [1.0, 0.0])], "signal_id string, query_no int, group_key string, embedding array<double>")
    index = VectorIndex.build(docs, str(tmp_path / "v"))
    assert [tuple(r)[:3] for r in index.topk(q, 5, 0.1).select("signal_id", "query_no", "doc_id").collect()] == [("s", 1, 1), ("s", 1, 1)]
    empty = VectorIndex.build(docs.limit(0), str(tmp_path / "e"))
    assert empty.topk(q, 5, 0.1).count() == 0
    assert index.topk(q.limit(0), 5, 0.1).count() == 0


def test_exact_search_sends_a_query_to_its_group_only(frame, tmp_path, monkeypatch):
    """Not once to each cell, whose number grows with the vectors."""
    queries, docs, expected = vectors(frame)
    index = VectorIndex.build(docs, str(tmp_path / "v"), cells=9)
    assert picked(retrieval.dense_topk(queries, index, k=4, min_similarity=0.1, probes=9)) == expected
    monkeypatch.setattr(vector_index, "_cells", None)
    assert picked(retrieval.dense_topk(queries, index, k=4, min_similarity=0.1, probes=None)) == expected
