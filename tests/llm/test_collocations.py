"""Collocations against plain counting, and the count transducers against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pharmasift.llm import collocations
from pharmasift.llm.collocations import Counts, Ranges, Shards

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain_counts(docs):
    f = defaultdict(Counter)
    for lang, text in docs:
        for w in pieces(text):
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang or "und"][tuple(w[i : i + m])] += 1
    return f


def plain(docs, least=30, top=2000):
    rows = []
    for lang, f in plain_counts(docs).items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            if 100 * around[p] >= 80 * a:
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(c for p, c in f.items() if len(p) == 1)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(rows)


def result(df, **options):
    out = collocations.collocations(df, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("options", [{}, {"shard_words": 700, "range_states": 4000, "block": 300}])
def test_given_documents(spark, options):
    """The small limits flush within texts, cut transducers and route parts between many ranges."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in df.select("lang", "text").collect()]
    assert result(df, least=10, top=100, **options) == plain(docs, least=10, top=100)


def test_one_long_piece_nulls_and_clashing_columns(spark):
    random.seed(2)
    docs = [(None, None), (None, ""), ("und", "x y " * 40), ("a", " \t.,\n"), ("a", "A b\tC; a B c d. \x0bE f\r" * 35), ("ä", "é É é\x1cz " * 31)]
    docs += [("a", " ".join(random.choices("a b c D e".split(), k=3000)))] * 2
    df = spark.createDataFrame([(t, x, 1, 2, "r") for t, x in docs], "lang string, text string, a int, n int, range string")
    assert result(df, shard_words=100, range_states=50, block=7) == plain(docs)
    assert result(df) == plain(docs)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "lang string, text string")) == []


WORDS = st.lists(st.sampled_from("a b aa ab c é".split()), min_size=1, max_size=4)
TABLE = st.dictionaries(WORDS.map(lambda w: tuple(x.encode() for x in w)), st.integers(1, 9), max_size=30)


def automaton(table):
    return Counts.from_sorted(sorted(table), [table[k] for k in sorted(table)])


def table_of(counts):
    found = {}
    for m, (_, _, weights) in enumerate(counts.levels):
        for phrase, n in zip(counts.phrases(m) if len(weights) else [], weights.tolist()):
            assert phrase not in found
            if n:
                found[tuple(phrase.split(b" "))] = n
    return found


@settings(max_examples=200, deadline=None)
@given(TABLE, TABLE, st.lists(WORDS.map(lambda w: tuple(x.encode() for x in w)), max_size=4))
def test_transducers_like_dictionaries(x, y, marks):
    a, b = automaton(x), automaton(y)
    assert table_of(a) == x
    assert table_of(Counts.from_bytes(a.to_bytes())) == x
    assert table_of(Counts.union([a, b])) == dict(Counter(x) + Counter(y))
    assert table_of(a.frequent(5)) == {k: n for k, n in x.items() if n >= 5}
    assert table_of(a.compose(b)) == {k: y[k] for k in x if k in y}
    marks = sorted(set(marks))
    ranges = Ranges([(b"l", m) for m in marks])
    parts = [table_of(c) for c in a.cut(marks)]
    assert len(parts) == len(ranges)
    for i, part in enumerate(parts):
        assert part == {k: n for k, n in x.items() if ranges.number("l", k) == i}
    if x:
        assert (a.first(), a.last()) == (min(x), max(x))
        assert Counter({k: n for c in a.blocks(2) for k, n in table_of(c).items()}) == Counter(x)
        dealt = dict(ranges.deal("l", a, min(x), max(x)))
        assert {i: table_of(c) for i, c in dealt.items()} == {i: p for i, p in enumerate(parts) if p}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab .\n", max_size=30), max_size=5), st.integers(4, 20))
def test_shards_of_any_size(texts, limit):
    shards = Shards(limit)
    found = [c for t in texts for _, c in shards.add("l", t.encode())] + [c for _, c in shards.flush()]
    total = Counter()
    for c in found:
        total.update(table_of(c))
    expected = plain_counts([("l", t) for t in texts])["l"]
    assert total == Counter({tuple(w.encode() for w in k): n for k, n in expected.items()})


def test_products_beyond_64_bits():
    """A score from counts near 10^14 stays exact; ties after flooring go to the smaller k."""
    big = 10**14 + 1
    c = Counts.from_sorted([(b"a",), (b"a", b"b"), (b"b",)], [big + 6, big, big + 9])
    assert table_of(Counts.from_bytes(c.to_bytes()))[(b"a", b"b")] == big
    assert collocations.worst_cut((b"a", b"b"), big, {b"a": big + 6, b"b": big + 9}) == (999999, 1, big + 6, big + 9)
    weight = {b"a": 10, b"b c": 10, b"a b": 10, b"c": 10}
    assert collocations.worst_cut((b"a", b"b", b"c"), 9, weight) == (900000, 1, 10, 10)


def test_ranges_stay_even_when_all_shards_are_alike(frame):
    """Pieces of all shards begin at about the same paths, so borders at first paths would leave few large ranges."""
    draw = random.Random(4)
    docs = frame([("en", " ".join(f"w{draw.randrange(3000)}" for _ in range(250))) for _ in range(300)], "lang string, text string")
    shards = collocations.shard_counts(docs, longest=2, shard_words=5000, block=2000).cache()
    ranges = Ranges.choose(shards, 4000)
    sizes = Counter()
    for r in shards.collect():
        first, last = (tuple(bytes(x).split(b" ")) for x in (r["first"], r["last"]))
        for number, part in ranges.deal(r["lang"], Counts.from_bytes(bytes(r["counts"])), first, last):
            sizes[number] += part.states
    assert len(ranges) > 20 and max(sizes.values()) < 3 * 4000
