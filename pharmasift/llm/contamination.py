"""Benchmark items inside documents, by MinHash containment search in DataFrame operations only.

An item's sketch is its m smallest shingle hashes. m depends on the item's size: with n
shingles of which `need` must occur, m = n - need + 1, so a document that contains the item
holds at least one of the sketch and no item is missed, however long the document is.
Items are partitioned by size, and a partition is only asked of documents large enough.
Candidates are then verified by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmasift.llm.common import need as must_have
from pharmasift.llm.common import let, small, stored

WORDS = 5
CONTAINMENT = 80  # per cent


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits: case, symbols and white space do not hide an item."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(words: Column, k: int, make) -> Column:
    """make(window) for every run of k words; null if there are fewer."""

    def windows(w: Column) -> Column:
        n = F.size(w) - (k - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: make(F.slice(w, i, k))))

    return let(words, windows)


def _shingles(words: Column, lengths: Sequence[int], make, kind: str) -> Column:
    """make(window) for every run of each of the lengths; null if there are none."""
    if len(lengths) == 1:
        return _windows(words, lengths[0], make)
    none = F.array().cast(f"array<{kind}>")

    def each(w: Column) -> Column:
        return let(F.concat(*(F.coalesce(_windows(w, k, make), none) for k in lengths)), lambda a: F.when(F.size(a) > 0, a))

    return let(words, each)


def hashed(words: Column, *lengths: int) -> Column:
    return _shingles(words, lengths, F.xxhash64, "bigint")


def spelled(words: Column, *lengths: int) -> Column:
    return F.array_distinct(_shingles(words, lengths, lambda w: F.array_join(w, " "), "string"))


def item_shingles(words: Column, k: int, make) -> Column:
    """An item's shingles of k words; of one with fewer words its whole sequence; null without words."""
    short = F.when((F.size(words) > 0) & (F.size(words) < k), F.array(make(words)))
    return F.coalesce(short, F.array_distinct(_windows(words, k, make)))


def _attached(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Inner join with a stored look-up: broadcast while its counted rows are few, else shuffled."""
    return df.join(F.broadcast(lookup) if small(lookup) else lookup, on)


def sketches(items: DataFrame, words: int, containment: int) -> DataFrame:
    """item, n, need, size_class and h: one row per sketch entry."""
    sets = items.select("item", item_shingles(F.col("words"), words, F.xxhash64).alias("s")).where("s IS NOT NULL")
    sized = sets.select("item", "s", F.size("s").alias("n")).withColumn("need", F.expr(f"({containment} * n + 99) div 100").cast("int"))
    return sized.select(
        "item", "n", "need",
        F.floor(F.log2("n")).cast("int").alias("size_class"),
        F.explode(F.slice(F.array_sort("s"), F.lit(1), F.col("n") - F.col("need") + 1)).alias("h"),
    )


def contained(
    docs: DataFrame,
    items: DataFrame,
    words: int = WORDS,
    containment: int = CONTAINMENT,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item it contains: id, item_id, n_item, n_shared.

    Contained means that at least `containment` per cent of the item's distinct `words`-word
    shingles occur in the document; an item with fewer words has its whole sequence as its only
    shingle. Null and empty texts have no shingles and match nothing. Repeated documents or items with the same id and
    text give one row; rows with the same id and different texts are looked at separately
    and give the best row of them. Null ids are kept as they are. Other columns are not read.
    """
    must_have(docs, id, text)
    must_have(items, item_id, item_text)
    known = stored(
        items.select(
            F.monotonically_increasing_id().alias("item"),
            F.col(item_id).alias("item_id"),
            words_of(F.col(item_text)).alias("words"),
        ),
        "items",
    )
    short = F.size("words")  # documents are asked for windows of the few lengths that occur
    lengths = sorted({words, *(r["n"] for r in known.where((short > 0) & (short < words)).select(short.alias("n")).distinct().collect())})
    sketch = stored(sketches(known, words, containment), "sketches")
    classes = sketch.groupBy("size_class").agg(F.min("need").alias("least"))
    entries = stored(sketch.join(F.broadcast(classes), "size_class").groupBy("h").agg(F.min("least").alias("least")), "sketch-hashes")

    key = docs.select(F.col(id).alias("id"), F.col(text).alias("_text"), F.xxhash64(text).alias("version"))
    grams = key.select("id", "version", hashed(words_of(F.col("_text")), *lengths).alias("s")).where("s IS NOT NULL")
    probes = grams.select("id", "version", F.size("s").alias("size"), F.explode("s").alias("h"))
    # a partition of items is asked only of documents that can hold its smallest item
    hits = _attached(probes, entries, "h").where("size >= least").select("id", "version").distinct()
    candidates = stored(hits, "candidates")

    match = key["id"].eqNullSafe(candidates["id"]) & (key["version"] == candidates["version"])
    few = F.broadcast(candidates) if small(candidates) else candidates
    again = key.join(few, match, "left_semi")
    found = again.select("id", "version", F.explode(spelled(words_of(F.col("_text")), *lengths)).alias("shingle"))
    parts = stored(
        known.select("item", "item_id", F.explode(item_shingles(F.col("words"), words, lambda w: F.array_join(w, " "))).alias("shingle")), "item-shingles"
    )
    sizes = stored(parts.groupBy("item", "item_id").agg(F.count(F.lit(1)).alias("n_item")), "item-sizes")
    shared = (
        _attached(found, parts.select("item", "shingle"), "shingle")
        .distinct()  # repeated rows of a document
        .groupBy("id", "version", "item")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )
    return (
        _attached(shared, sizes, "item")
        .where(f"100 * n_shared >= {containment} * n_item")
        .groupBy(F.col("id").alias(id), F.col("item_id").alias("item_id"), "n_item")
        .agg(F.max("n_shared").alias("n_shared"))
        .select(id, "item_id", "n_item", "n_shared")
    )
