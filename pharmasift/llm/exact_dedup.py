"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text without white space is cut into blocks of fixed size. The distinct blocks are
sorted and get integer names; then pairs of neighbouring names are sorted and named in the same
way, level by level, until every document has a single name. Names stand for content
one to one, so equal (length, name) means equal texts: no fingerprint decides.

A block's content is shuffled once, to be named. Its 64-bit hash then finds its name; the
few hashes that several contents share, if any, are resolved by the contents themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharmasift.llm.common import let, need, stored, without

BLOCK = 4096


def without_space(text: Column) -> Column:
    """The text without its characters of [\\x20\\x09-\\x0D], by plain byte replacement."""
    for space in " \t\n\v\f\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _blocks(norm: Column, size: int) -> Column:
    """Blocks of `size` bytes, in order; bytes because offsets into them are free."""

    def cut(whole: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.octet_length(whole) / size)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(whole, i * size + 1, F.lit(size)))

    return let(norm.cast("binary"), cut)


def _named(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sorts distinct rows and numbers them: the partition, then the place in it.

    Stored at once, so that every later stage sees one numbering.
    """
    return stored(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), name)


def _block_names(docs: DataFrame, block: str, size: int, hash: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """h, block, name of every distinct block, and the hashes that several blocks share."""
    contents = docs.select(F.explode(_blocks(F.col(block), size)).alias("block"))
    distinct = contents.select(hash(F.col("block")).alias("h"), "block").distinct()
    names = _named(distinct, ["h", "block"], "block-names")
    shared = names.groupBy("h").count().where("count > 1").select("h")
    return names, shared


def mark(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = BLOCK,
    hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too.

    Of equal texts (white space aside; null counts as empty) the row with the most code
    points in its original text stays, then the smallest id; a null id comes last. Rows with the same id and
    equal texts are copies of each other: one of them stays. An empty table gives no
    rows; other columns are not read, so their names cannot clash. `hash` is a
    parameter for tests of colliding hashes.
    """
    need(docs, id, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    cleaned = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id).alias("id"),
        F.char_length(whole).alias("chars"),
        without_space(whole).alias("norm"),
    )
    rows = stored(
        cleaned.select(
            "row", "id", "chars",
            F.octet_length("norm").alias("bytes"),
            F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
            F.transform(_blocks(F.col("norm"), size), lambda b: hash(b)).alias("hashes"),
        ),
        "texts",
    )
    texts = docs.select(without_space(whole).alias("norm"))
    names, shared = _block_names(texts, "norm", size, hash)

    places = rows.select("row", "bytes", F.posexplode("hashes").alias("at", "h"))
    if shared.isEmpty():
        named = places.join(names.select("h", "name"), "h").select("row", "bytes", "at", "name")
    else:
        named = _with_collisions(docs, whole, places, rows, names, shared, id, size, hash)
    identity = _merge(named)

    of_row = rows.drop("hashes").join(identity, "row")
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), "id", "row")).alias("best")
    # stored, so that the join below stands alone in its stage and a hot group's rows can be split
    groups = stored(of_row.groupBy("bytes", "name").agg(best, F.count(F.lit(1)).alias("group_size")), "groups")
    marked = of_row.select("row", "id", "sha", "bytes", "name").join(groups, ["bytes", "name"])
    return marked.select(
        F.col("id").alias(id),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _with_collisions(docs, whole, places, rows, names, shared, id, size, hash) -> DataFrame:
    """Names where some hash stands for several contents: those blocks are compared themselves.

    Documents that have such a block are read again; their rows are found by id, length and hashes.
    """
    plain = places.join(shared, "h", "left_anti").join(names.select("h", "name"), "h").select("row", "bytes", "at", "name")
    again = docs.select(
        F.col(id).alias("id"), F.char_length(whole).alias("chars"), F.sha2(without_space(whole).cast("binary"), 256).alias("sha"),
        F.posexplode(_blocks(without_space(whole), size)).alias("at", "block"),
    ).withColumn("h", hash(F.col("block")))
    same = again.join(shared, "h", "left_semi").distinct()
    named = same.join(names, ["h", "block"]).select("id", "chars", "sha", "at", "name")
    keyed = rows.select("row", "bytes", "chars", "sha", "id", F.posexplode("hashes").alias("at", "h")).join(shared, "h", "left_semi")
    met = (
        keyed["id"].eqNullSafe(named["id"]) & (keyed["chars"] == named["chars"])
        & (keyed["sha"] == named["sha"]) & (keyed["at"] == named["at"])
    )
    return plain.unionByName(keyed.join(named, met).select("row", "bytes", keyed["at"], "name"))


def _merge(named: DataFrame) -> DataFrame:
    """row, name: neighbouring names are paired and named until a document has one.

    The number of levels is the logarithm of the longest document's blocks. Documents
    leave as soon as they have a single name.
    """
    level = stored(named, "names-0")
    done = []
    many = level.where("at > 0").select("row").distinct()
    while not many.isEmpty():
        done.append(level.join(many, "row", "left_anti").select("row", "name"))
        pairs = (
            level.join(many, "row", "left_semi")
            .groupBy("row", F.expr("at div 2").alias("at"))
            .agg(
                F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pairs = stored(pairs, "pairs")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names")
        level = stored(pairs.join(names, ["a", "b"]).select("row", "at", "name"), "names")
        many = level.where("at > 0").select("row").distinct()
    for part in [*done, level.select("row", "name")][1:] if done else []:
        done[0] = done[0].unionByName(part)
    return done[0] if done else level.select("row", "name")


def drop_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that `mark` keeps, with all their columns.

    Rows are found by their id. Only where an id has several rows are these told apart by
    their texts; of rows equal in that too one stays.
    """
    marks = stored(mark(docs, id, text), "marks")
    repeated = stored(marks.groupBy(id).count().where("count > 1").select(id), "repeated-ids")
    dropped = stored(marks.where(~F.col("kept")).select(id), "dropped")
    if repeated.isEmpty():
        return without(docs, dropped, id)
    single = without(docs, stored(dropped.union(repeated), "dropped"), id)
    several = repeated.select(F.col(id).alias("_id"))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.join(several, docs[id].eqNullSafe(several["_id"]), "left_semi").withColumn(
        "_sha", F.sha2(without_space(whole).cast("binary"), 256)
    )
    keep = marks.where("kept").select(F.col(id).alias("_keep"), F.col("text_sha256").alias("_keep_sha"))
    rows = rows.join(keep, rows[id].eqNullSafe(keep["_keep"]) & (rows["_sha"] == keep["_keep_sha"]), "left_semi")
    longest = Window.partitionBy(id, "_sha").orderBy(F.char_length(whole).desc(), F.sha2(whole.cast("binary"), 256))
    return single.unionByName(rows.withColumn("_n", F.row_number().over(longest)).where("_n = 1").drop("_n", "_sha"))
