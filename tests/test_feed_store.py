"""Substring index and seek pages against scans and whole orders."""

import random

import pytest
from pyspark.sql import functions as F

from pharmasift.operators import review, substring_index
from pharmasift.operators.feed_store import FeedStore
from tests.conftest import rows

FEED = "drug_key string, pt string, prr double, drug_reaction_count long, death_count long, priority string"


@pytest.fixture(scope="module")
def feed(frame):
    draw = random.Random(3)
    out = {}
    for _ in range(300):
        key = ("".join(draw.choices("abCé%_ .", k=draw.randrange(0, 12))), "".join(draw.choices("abx", k=draw.randrange(1, 25))))
        out[key] = (*key, draw.choice([None, 1.0, 2.0, 2.5]), draw.randrange(4), draw.choice([None, 0, 3]), draw.choice([None, "P1", "P2", "p3", "P4"]))
    return frame(list(out.values()), FEED)


@pytest.fixture(scope="module")
def index(feed, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams") / "ix")
    substring_index.store(feed.where("length(pt) % 2 = 0"), path)
    substring_index.store(feed.where("length(pt) % 2 = 1"), path, "append")
    return path


def test_searches_of_any_length_equal_the_scan(spark, feed, index):
    draw = random.Random(5)
    texts = [t for r in feed.select("drug_key", "pt").limit(40).collect() for t in r]
    searches = ["", "a", "AB", "%", "_", "é", "abab", "zzz", "\\", "c%"]
    for n in range(3, 21, 3):
        fitting = [t for t in texts if len(t) >= n]
        if fitting:
            t = draw.choice(fitting)
            at = draw.randrange(len(t) - n + 1)
            searches.append(t[at : at + n].upper())
    for search in searches:
        found = rows(substring_index.search(spark, index, search))
        expected = feed if not search else review.filter_feed(feed, search=search)
        assert found == rows(expected.select("drug_key", "pt").distinct()), search


def test_only_the_trigrams_asked_for_are_read(spark, index):
    plan = substring_index.candidates(spark, index, "abax")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(gram" in plan


@pytest.mark.parametrize("by", ["feed", "priority", "prr", "cases", "deaths"])
def test_pages_joined_equal_the_whole_feed(spark, feed, tmp_path, by):
    store = FeedStore.write(feed, str(tmp_path / "f"), by, ranges=9)
    seen, after = [], None
    while True:
        page = store.page(37, after).collect()
        if not page:
            break
        seen += [(r.drug_key, r.pt) for r in page]
        after = store.position(page[-1])
    whole = review.order_feed(feed.fillna({"drug_key": ""}), by)
    assert seen == [(r.drug_key, r.pt) for r in whole.select("drug_key", "pt").collect()]


def test_deep_pages_read_few_ranges(spark, feed, tmp_path):
    store = FeedStore.write(feed, str(tmp_path / "f"), ranges=12)
    everything = store.page(10_000).collect()
    after = store.position(everything[-40])
    names = {r[0] for r in store.page(10, after).select(F.input_file_name()).collect()}
    plan = store.page(10, after)._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(names) <= 3 and "_range" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_empty_feed(spark, feed, tmp_path):
    store = FeedStore.write(feed.limit(0), str(tmp_path / "f"))
    assert store.page(5).collect() == []
    substring_index.store(feed.limit(0), str(tmp_path / "g"))
    assert substring_index.search(spark, str(tmp_path / "g"), "abc").count() == 0
