"""Exact and near duplicates and components against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pharmasift.llm import components, exact_dedup, near_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def exact(rows):
    groups = {}
    for n, (i, text) in enumerate(rows):
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), i is None, i or 0, n, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((m[4], best[4], len(members), m[3] == best[3], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b  c"), (4, "a\tb\n\v\f\rc "), (5, None), (6, ""), (7, "  "), (8, "abd"), (9, "é" * 50), (10, "é " * 50),
    (11, "x" * 40 + "y"), (12, "x" * 40 + "z"), (13, "x" * 40 + "y "), (2, "abc"), (14, "a bc"), (15, "xy" * 500), (16, "x" + "yx" * 499 + "y"), (17, "yx" * 500),
]


@pytest.mark.parametrize("size", [1, 3, 16, 4096])
@pytest.mark.parametrize("hash", [F.xxhash64, lambda c: F.length(c).cast("long")], ids=["xxhash", "colliding"])
def test_block_names_tell_texts_apart(spark, as_list, size, hash):
    if size == 1 and hash is not F.xxhash64:
        size = 2
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).selectExpr("*", "1 AS row", "2 AS bytes", "3 AS kept", "4 AS norm")
    assert as_list(exact_dedup.mark(docs, size=size, hash=hash)) == exact(ROWS)


def test_null_ids_and_nothing(spark, as_list):
    rows = [(None, "a b"), (1, "ab"), (None, "q"), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = as_list(exact_dedup.mark(docs).drop("kept"))
    assert found == sorted(((a, b, c, e) for a, b, c, _, e in exact(rows)), key=str)
    assert exact_dedup.mark(docs).where("kept").count() == 2
    assert exact_dedup.mark(docs.limit(0)).collect() == []


def test_dropping_leaves_whole_rows(spark, as_list):
    rows = [(1, "a b", "s"), (1, "a  b", "t"), (1, "c", "u"), (2, "ab", "v"), (3, "d", None), (3, "d", None), (None, None, "w"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = as_list(exact_dedup.drop_duplicates(docs))
    assert [r for r in left if r[0] is not None] == [(1, "a  b", "t"), (1, "c", "u"), (3, "d", None)] and len(left) == 4
    once = spark.createDataFrame([(1, "a"), (2, " a"), (3, "b")], "doc_id long, text string")
    assert as_list(exact_dedup.drop_duplicates(once)) == [(2, " a"), (3, "b")]


def find(edges, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(110)] + [(5, 5), (7, 8), (7, 8)]
    edges += [(300 + i, 301 + i) for i in range(40)] + [(400 + i * 7 % 31, 400 + (i + 1) * 7 % 31) for i in range(30)] + [(600, 600 + i) for i in range(50)]
    expected = find(edges, {n for e in edges for n in e})
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == expected


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(rows, k, similarity=80):
    sets = [shingles(t, k) for _, t in rows]
    edges = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])
    ]
    groups = find(edges, range(len(rows)))
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[groups[n]] = min(i, least.get(groups[n], i))
    out = []
    for n, (i, _) in enumerate(rows):
        c = least.get(groups[n]) if sets[n] else i
        out.append((i, len(sets[n]), c, i == c))
    return sorted(out, key=str)


def varied(seed):
    """Groups of copies with words changed, chains whose ends are unlike, texts that share a passage."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        text = [draw.choice(words) for _ in range(draw.choice([3, 8, 30, 120]))]
        for _ in range(draw.choice([1, 2, 6, 25])):
            copy = list(text)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(draw.choice([" ", "\n", "  "]).join(copy))
            if draw.random() < 0.3:
                text = copy  # drift
    shared = " ".join(draw.choice(words) for _ in range(60))
    rows += [" ".join(draw.choice(words) for _ in range(20)) + " " + shared for _ in range(30)]
    ids = list(range(len(rows)))
    draw.shuffle(ids)
    return [*zip(ids, rows), (900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "é É"), (906, "É é"), (950, "w1 w2 w3 w4"), (950, "w7 w8")]


@pytest.mark.parametrize("seed, k, block", [(0, 2, 64_000), (1, 2, 100), (2, 5, 64_000), (3, 1, 1)])
def test_components_of_similar_texts(spark, as_list, seed, k, block):
    rows = varied(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS id", "3 AS n_shingles", "4 AS hi")
    assert as_list(near_dedup.near_duplicates(docs, words=k, block=block)) == near(rows, k)


def test_near_duplicates_null_ids_and_nothing(spark, as_list):
    rows = [(None, "a b c"), (4, "a b c"), (None, "q r"), (None, "q r"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = as_list(near_dedup.near_duplicates(docs, words=2).drop("kept"))
    assert found == sorted([(None, 2, 4), (4, 2, 4), (None, 1, None), (None, 1, None), (3, 0, 3)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_word_numbers_do_not_depend_on_slices():
    make = near_dedup.Shingles(2)
    text = ("Alpha beta  gamma\n" * 60_000).encode()
    assert len(text) > near_dedup.GROUP_BYTES
    w = make.word_hashes(text)
    assert len(w) == 180_000 and set(w[:3]) == set(w) and len(make.of(text)) == 3
    assert list(make.word_hashes(b"ALPHA x")) == [w[0], make.word_hashes(b"x")[0]]


def test_signatures_agree_as_often_as_sets_are_alike():
    draw = np.random.RandomState(0)
    fold = near_dedup.Signatures(200, 1)
    for size in (1, 2, 5, 10, 60, 1000):
        hits = []
        for _ in range(30):
            a = near_dedup.mix(draw.randint(0, 1 << 62, size).astype(np.uint64))
            b = a.copy()
            b[: size // 5] = near_dedup.mix(draw.randint(0, 1 << 62, size // 5).astype(np.uint64))
            hits.append((fold.bands_of(np.sort(a)) == fold.bands_of(np.sort(b))).mean())
        same, other = size - size // 5, 2 * (size // 5)
        assert abs(np.mean(hits) - same / (same + other)) < 0.05


def test_counts_of_shared_shingles():
    draw = np.random.RandomState(1)
    sets = [np.unique(draw.randint(0, top, n)) for top, n in [(50, 40), (50, 30), (5000, 300), (40, 35), (10**6, 200), (60, 1), (50, 45)] * 6]
    offsets = np.cumsum([0, *map(len, sets)])
    left, right = np.arange(0, 20), np.arange(13, 42)
    counts = near_dedup.shared_counts(np.concatenate(sets), offsets, left, right, width=16)
    assert counts.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]


def blocks_of(sets):
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)])


@pytest.mark.parametrize("side", [1, 3, 2048])
def test_linked_blocks_find_every_two_linked_components(side):
    draw = np.random.RandomState(2)
    base = [draw.choice(60, 12, replace=False) for _ in range(6)]
    sets = [np.unique(np.r_[draw.permutation(base[i % 6])[: draw.randint(10, 13)], draw.randint(60, 70, i % 2)]) for i in range(60)]
    roots = draw.randint(0, 25, 60)
    left, right = np.arange(0, 35), np.arange(20, 60)
    a, b = near_dedup.linked_blocks(*blocks_of(sets), roots, left, right, 80, side)
    alike = {(i, j) for i in left for j in right if roots[i] != roots[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert alike and set(zip(a, b)) <= alike
    assert sorted(zip(roots[a], roots[b])) == sorted({(roots[i], roots[j]) for i, j in alike})


def test_blocks_of_many_short_sets_take_little_memory():
    one = [np.array([0, i]) for i in range(1, 30_001)]  # like 'thank you X'
    two = [np.array([0, i, j]) for i in range(1, 101) for j in range(101, 201)]
    for sets, links in ((one, 0), ([*two, np.array([0, 1, 101, 102, 103]), np.array([0, 1, 101, 102])], 1)):
        every = np.arange(len(sets))
        tracemalloc.start()
        a, b = near_dedup.linked_blocks(*blocks_of(sets), every, every, every, 80)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {*zip(a, b)} == ({(10_000, 10_001), (10_001, 10_000)} if links else set())
        assert peak < 500e6
