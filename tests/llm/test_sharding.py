"""Shards: every row once, gapless slots, whole groups, even sizes."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pharmasift.llm import sharding


def check(rows, docs, shards=16):
    """Columns against the input, slots gapless, groups whole unless larger than a shard's share; the loads."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs
    )
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = np.zeros((shards, 3))
    places, sizes = defaultdict(set), defaultdict(lambda: np.zeros(3))
    for r in rows:
        v = np.array([r.size, r.tokens, 1])
        loads[r.shard] += v
        key = (r.size, r.text_crc32)
        places[key].add(r.shard)
        sizes[key] += v
    share = loads.sum(axis=0) / shards
    for key, found in places.items():
        assert len(found) == 1 or (sizes[key] > share).any()
    return loads


@pytest.mark.parametrize("task_items, per_task", [(sharding.TASK_ITEMS, sharding.NUMBERED_ROWS), (150, 40)])
def test_given_documents(spark, task_items, per_task):
    """The small limits take several rounds and many numbering tasks."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(df, task_items=task_items, per_task=per_task).collect()
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    loads = check(rows, docs)
    largest = max(len((t or "").encode()) for _, t in docs)
    assert loads[:, 0].max() - loads[:, 0].min() <= largest
    assert (loads.max(axis=0) <= 1.1 * loads.min(axis=0)).all()


def test_hot_group_null_and_repeated_rows(spark):
    """A third of the rows is one text, a fifth null; ids null and repeated; clashing columns."""
    random.seed(1)
    docs = [(i, "the same text") for i in range(400)] + [(None, None)] * 150 + [(7, ""), (7, ""), (8, "é é " * 80)]
    docs += [(1000 + i, f"{i} " + "w " * random.randrange(40)) for i in range(650)]
    rows = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, shard int, digest string")
    loads = check(sharding.shard_documents(rows).collect(), docs)
    assert loads[:, 2].max() <= 1.1 * loads[:, 2].min()
    assert loads[:, 0].max() <= 1.1 * loads[:, 0].min()


def test_named_tokens(spark):
    rows = spark.createDataFrame([(1, "a b", 5), (2, "c", None)], "doc_id long, text string, n long")
    got = sharding.shard_documents(rows, shards=2, tokens="n").collect()
    assert sorted((r.doc_id, r.tokens) for r in got) == [(1, 5), (2, 0)]
    assert {r.shard for r in got} == {0, 1}


def test_few_and_no_rows(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = sharding.shard_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    check(rows, [(1, None)])


def test_place_takes_the_highest_dot_product():
    """Against the rule written out: residual capacity times the item's shares."""
    random.seed(5)
    vectors = np.array([[random.random(), random.random(), 1.0] for _ in range(60)])
    scaled = vectors / vectors.sum(axis=0)
    left = [[1 / 4] * 3 for _ in range(4)]
    expected = [0] * 60
    for i in sorted(range(60), key=lambda i: (-max(scaled[i]), i)):
        dots = [sum(a * b for a, b in zip(r, scaled[i])) for r in left]
        b = dots.index(max(dots))
        expected[i] = b
        left[b] = [a - x for a, x in zip(left[b], scaled[i])]
    assert sharding.place(vectors, 4).tolist() == expected


def test_settling_never_makes_it_worse():
    random.seed(6)
    for _ in range(20):
        n = random.randrange(1, 80)
        vectors = np.array([[random.randrange(1, 50), random.randrange(5), 1] for _ in range(n)], float)
        before = sharding.place(vectors, 5)
        after = sharding.settle(vectors, before.copy(), 5)

        def squares(out):
            loads = np.zeros((5, 3))
            np.add.at(loads, out, vectors / np.maximum(vectors.sum(axis=0), 1))
            return (loads**2).sum()

        assert squares(after) <= squares(before) + 1e-12
