"""A BM25 index that grows by segments and reads only what can reach the top k.

A segment is a folder of Parquet tables made from some documents; an index is a list of
segments. Statistics of the corpus (document frequencies, lengths) are sums over segments,
so that adding documents or uniting segments never touches the others.

    docs       group, doc_id, n_tokens                       all documents, also those without words
    postings   term, group, block, doc_id, n_tokens, tf      by hash bucket of the term
    blocks     term, group, block, max_tf, min_tokens        by hash bucket of the term
    terms      term, df                                      by hash bucket of the term
    lengths    group, n_docs, n_tokens

Postings hold all that is known of a text, so segments are united from them, and no text is read or counted again.
Blocks are bounded sets of documents of one group and similar length. The largest frequency and
the smallest length of a term in a block bound its weight there, whatever the mean length of the
corpus becomes. A search first scores each query's most promising blocks; its k-th score is
the threshold that the bound of any other block must reach to be read. The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pharmasift.operators.blocks import RESULT, rank_lists
from pharmasift.operators.joins import attach, measured_bytes
from pharmasift.operators.storage import stored

#: Fixed for the life of an index: terms are found again by it.
BUCKETS = 64
#: Documents of a block, about.
BLOCK_DOCS = 4096
#: Postings of one file, about.
FILE_POSTINGS = 4_000_000
#: Queries scored together with one block.
QUERY_BLOCK = 2048
#: Blocks that each query reads before it knows a threshold.
FIRST_BLOCKS = 2
#: Up to so many asked terms are also pushed down to the files.
PUSHED_TERMS = 200

_PLACE = ("segment", "group_key", "block")

_TABLES = {
    "docs": "group_key {group}, doc_id {id}, n_tokens int",
    "postings": "group_key {group}, block int, doc_id {id}, n_tokens int, term string, tf long, bucket int",
    "blocks": "term string, group_key {group}, block int, max_tf long, min_tokens int, n_docs long, bucket int",
    "terms": "term string, df long, bucket int",
    "lengths": "group_key {group}, n_docs long, n_tokens long",
}


def read(spark: SparkSession, segment: str, name: str) -> DataFrame:
    """A table of a segment; partitioned tables of a segment without words have no files."""
    docs = spark.read.parquet(f"{segment}/docs").schema
    kinds = {"group": docs["group_key"].dataType.simpleString(), "id": docs["doc_id"].dataType.simpleString()}
    return spark.read.schema(_TABLES[name].format(**kinds)).parquet(f"{segment}/{name}")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_segment(docs: DataFrame, path: str, group: str = "group_key", block_docs: int = BLOCK_DOCS) -> str:
    """Index the documents (doc_id, group, text) below `path`; each text is split once."""
    from pharmasift.operators.retrieval import tokenized

    counted = stored(counted_words(tokenized(docs, group).withColumnRenamed(group, "group_key")), "counted-words")
    counted.drop("terms").write.mode("error").parquet(f"{path}/docs")
    _write_tables(docs.sparkSession, path, counted, block_docs)
    return path


def counted_words(texts: DataFrame) -> DataFrame:
    """`words` replaced by `terms`: each different word of a row with its frequency, from the runs of the sorted words."""
    n, words = F.col("n_tokens"), F.col("words")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    runs = texts.withColumn("words", F.sort_array("words")).withColumn("_at", F.when(n > 0, starts).otherwise(F.array().cast("array<int>")))
    terms = F.transform(
        "_at", lambda i, j: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(F.col("_at"), j + 1), n) - i).cast("long").alias("tf"))
    )
    return runs.withColumn("terms", terms).drop("words", "_at")


def _size_class() -> Column:
    return F.floor(F.log2(F.col("n_tokens") + 1)).cast("int").alias("_class")


def _dealt(rows: DataFrame, files: int, share: Column) -> DataFrame:
    """Each bucket's rows in `files` tasks, numbered `_part`; before Spark 4.1 a task may get several of these."""
    part = F.col("bucket") * files + F.pmod(share, F.lit(files)).cast("int")
    numbered = rows.withColumn("_part", part)
    deal = getattr(numbered, "repartitionById", numbered.repartition)
    return deal(BUCKETS * files, F.col("_part"))


def _placed(counted: DataFrame, parts: DataFrame, files: int, repeated: bool) -> DataFrame:
    """Postings in their new blocks, shuffled once, to where they are written."""
    # as a struct, for documents without a group count in the frequencies too
    keyed = parts.select(F.struct("group_key", "_class").alias("_key"), "_parts")
    placed = attach(counted.select("*", F.struct("group_key", _size_class()).alias("_key")), keyed, ["_key"], "inner", bound=measured_bytes(parts))
    number = F.col("_key._class") * (1 << 24) + F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int")
    term = [F.inline("terms")] if "terms" in counted.columns else ["term", "tf"]
    each = placed.select("group_key", number.alias("block"), "doc_id", "n_tokens", *term)
    rows = _dealt(each.withColumn("bucket", bucket(F.col("term"))), files, F.xxhash64("doc_id"))
    if repeated:
        rows = rows.groupBy("_part", "bucket", "group_key", "block", "doc_id", "n_tokens", "term").agg(F.sum("tf").alias("tf"))
    return rows.drop("_part").select("group_key", "block", "doc_id", "n_tokens", "term", "tf", "bucket")


def _write_tables(spark: SparkSession, path: str, counted: DataFrame, block_docs: int) -> None:
    """All tables but the stored `docs`, from these and their counted words: `terms`, or a row for each term.

    Rows of the same group, id and length are one document.
    """
    alike = read(spark, path, "docs").groupBy("group_key", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = stored(
        alike.groupBy("group_key", _size_class()).agg(
            F.sum("_rows").alias("_n"), F.sum(F.col("_rows") * F.col("n_tokens")).alias("_tokens"), F.max("_rows").alias("_rows")
        ),
        "sizes",
    )
    sizes.groupBy("group_key").agg(F.sum("_n").alias("n_docs"), F.sum("_tokens").alias("n_tokens")).coalesce(1).write.mode("error").parquet(
        f"{path}/lengths"
    )
    parts = sizes.select("group_key", "_class", F.ceil(F.col("_n") / block_docs).cast("int").alias("_parts"))
    total, rows = sizes.agg(F.sum("_tokens"), F.max("_rows")).first()
    files = max(1, (total or 0) // (FILE_POSTINGS * BUCKETS))
    (
        _placed(counted, parts, files, (rows or 0) > 1)
        .sortWithinPartitions("bucket", "term", "group_key", "block")
        .write.mode("error").partitionBy("bucket").parquet(f"{path}/postings")
    )
    # rows meet where they are written, so that each table takes one shuffle; the bucket's own hash would not divide its terms
    share = F.hash("term")
    blocks = _dealt(read(spark, path, "postings"), files, share).groupBy("_part", "bucket", "term", "group_key", "block").agg(
        F.max("tf").alias("max_tf"), F.min("n_tokens").alias("min_tokens"), F.count(F.lit(1)).alias("n_docs")
    )
    (
        blocks.drop("_part").sortWithinPartitions("bucket", "term", "group_key").write.mode("error").partitionBy("bucket").parquet(f"{path}/blocks")
    )
    terms = _dealt(read(spark, path, "blocks"), files, share).groupBy("_part", "bucket", "term").agg(F.sum("n_docs").alias("df"))
    terms.drop("_part").sortWithinPartitions("bucket", "term").write.mode("error").partitionBy("bucket").parquet(f"{path}/terms")


@dataclass(frozen=True)
class TextIndex:
    """Segments searched as one corpus, with the parameters of the weight."""

    spark: SparkSession
    segments: tuple[str, ...]
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    def add(self, docs: DataFrame, path: str, group: str = "group_key", block_docs: int = BLOCK_DOCS) -> TextIndex:
        """With the documents as a further segment; the present ones stay as they are."""
        return self._with((*self.segments, write_segment(docs, path, group, block_docs)))

    def merge(self, segments: Sequence[str], path: str, block_docs: int = BLOCK_DOCS) -> TextIndex:
        """With these segments united in one, written below `path` from their postings."""
        docs, postings = (reduce(DataFrame.unionByName, (read(self.spark, s, t) for s in segments)) for t in ("docs", "postings"))
        docs.write.mode("error").parquet(f"{path}/docs")
        _write_tables(self.spark, path, postings, block_docs)
        return self._with((*(s for s in self.segments if s not in set(segments)), path))

    def _with(self, segments: tuple[str, ...]) -> TextIndex:
        return TextIndex(self.spark, segments, self.k1, self.b, self.epsilon)

    def table(self, name: str) -> DataFrame:
        parts = [read(self.spark, s, name).withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def lengths(self) -> tuple[int, float]:
        """Documents and their mean length; two numbers reach the driver."""
        n, tokens = self.table("lengths").agg(F.sum("n_docs"), F.sum("n_tokens")).first()
        return n or 0, (tokens or 0) / n if n else 0.0

    def raw_weight(self, df: Column) -> Column:
        n = F.lit(float(self.lengths[0]))
        return F.log(n - df + 0.5) - F.log(df + 0.5)

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """term, df over all segments."""
        found = terms if terms is not None else self.table("terms")
        return found.groupBy("term").agg(F.sum("df").alias("df"))

    @cached_property
    def mean_raw(self) -> float:
        """Mean raw weight of all terms, read only if an asked word is in more than half of the documents."""
        return self.frequencies().agg(F.avg(self.raw_weight(F.col("df")))).first()[0] or 0.0

    def saturation(self, tf: Column, n_tokens: Column) -> Column:
        """Weight of a frequency in a text of this length; grows with the one and falls with the other."""
        length = n_tokens / F.lit(self.lengths[1] or 1.0)
        return tf * (self.k1 + 1) / (tf + (F.lit(1 - self.b) + length * self.b) * self.k1)

    def weighted(self, words: DataFrame) -> DataFrame:
        """Query words with their weight; stored, as all later steps start from it. Unknown words drop out."""
        asked = words.select("term").distinct().withColumn("bucket", bucket(F.col("term")))
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        terms = self.table("terms").where(F.col("bucket").isin(buckets))
        df = stored(self.frequencies(attach(terms, asked.select("term"), ["term"], "inner", bound=measured_bytes(asked))), "asked-terms")
        raw = self.raw_weight(F.col("df"))
        idf = raw
        if not df.where(raw < 0).isEmpty():
            idf = F.when(raw < 0, F.lit(self.mean_raw * self.epsilon)).otherwise(raw)
        return stored(words.join(df, "term").withColumn("weight", F.col("qtf") * idf).drop("df", "qtf"), "weighted-words")

    def topk(self, words: DataFrame, k: int, min_score: float, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """signal_id, query_no, doc_id, score, rank: the k best documents of each query's group.

        `words` has signal_id, query_no, group_key, term, qtf; words found in no document don't count.
        """
        weighted = self.weighted(words)
        asked = [r[0] for r in weighted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        buckets = [r[0] for r in weighted.select(bucket(F.col("term"))).distinct().collect()]

        def pruned(name: str) -> DataFrame:
            found = self.table(name).where(F.col("bucket").isin(buckets))
            return found.where(F.col("term").isin(asked)) if len(asked) <= PUSHED_TERMS else found

        bound = F.greatest(F.lit(0.0), F.col("weight") * self.saturation(F.col("max_tf"), F.col("min_tokens")))
        reach = (
            attach(pruned("blocks"), weighted, ["group_key", "term"], "inner", bound=measured_bytes(weighted))
            .groupBy(*_PLACE, "signal_id", "query_no")
            .agg(F.sum(bound).alias("bound"))
            .where(F.col("bound") >= min_score - 1e-9)
        )
        # two passes read the postings of asked words: found once among all the others
        asks = weighted.select("group_key", "term").distinct()
        postings = stored(attach(pruned("postings"), asks, ["group_key", "term"], "inner", bound=measured_bytes(asks)), "asked-postings")
        order = Window.partitionBy("signal_id", "query_no").orderBy(F.desc("bound"), "segment", "block")
        reach = stored(reach.withColumn("turn", F.row_number().over(order)), "bounds")
        first = stored(self._scored(reach.where(F.col("turn") <= first_blocks), weighted, postings, k, min_score), "first-blocks")
        filled = rank_lists(first, k).groupBy("signal_id", "query_no").agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("threshold")
        )
        later = reach.where(F.col("turn") > first_blocks).join(filled, ["signal_id", "query_no"], "left")
        open_blocks = later.where(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - 1e-8)).drop("threshold")
        return rank_lists(first.unionByName(self._scored(open_blocks, weighted, postings, k, min_score)), k)

    def _scored(self, chosen: DataFrame, weighted: DataFrame, postings: DataFrame, k: int, min_score: float) -> DataFrame:
        """The k best documents of each chosen (query, block); a block's postings go to the query blocks that ask their word."""
        from pharmasift.operators.retrieval import best_by_words

        blocks = max(1, -(-weighted.select("signal_id", "query_no").distinct().count() // QUERY_BLOCK))
        part = F.pmod(F.xxhash64("signal_id", "query_no"), F.lit(blocks)).cast("int")
        q = attach(
            chosen.select(*_PLACE, "signal_id", "query_no"), weighted, ["signal_id", "query_no", "group_key"], "inner", bound=measured_bytes(weighted)
        ).withColumn("_q", part)
        # postings meet the words of the query blocks and then the chosen blocks, both small, before they are shuffled
        asks = weighted.select("group_key", "term", part.alias("_q")).distinct()
        places = chosen.select(*_PLACE, part.alias("_q")).distinct()
        impact = self.saturation(F.col("tf"), F.col("n_tokens")).alias("weight")
        wanted = attach(postings, asks, ["group_key", "term"], "inner", bound=measured_bytes(asks))
        items = attach(wanted, places, [*_PLACE, "_q"], "inner", bound=measured_bytes(places)).select(*_PLACE, "_q", "doc_id", "term", impact)
        keys = [*_PLACE, "_q"]

        def run(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
            return best_by_words(qs.rename(columns={"weight": "qtf"}), ds, k, min_score)

        schema = RESULT.format(id_type=postings.schema["doc_id"].dataType.simpleString())
        return q.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInPandas(run, schema)
