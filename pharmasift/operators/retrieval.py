"""Dense and BM25 retrieval inside a group, rank fusion and literature scores.

Query rows: signal_id, query_no, group column, `text` and/or `embedding`.
Documents: doc_id, group column, `text` and/or `embedding`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pharmasift.functions import scores
from pharmasift.functions.rounding import half_even
from pharmasift.functions.text import fixed, tokens
from pharmasift.operators.blocks import best_of_row, block_grid, blocked_topk
from pharmasift.operators.joins import SMALL_BYTES, attach, estimated_bytes, measured_bytes, spread_small, with_scalars
from pharmasift.operators.storage import stored
from pharmasift.operators import vector_index
from pharmasift.operators.text_index import TextIndex
from pharmasift.operators.vector_index import VectorIndex

# List length, similarity floor, score floor, fusion constant,
# hits kept per signal and the published default BM25 parameters.
LIST_LENGTH = 10
MIN_SIMILARITY = 0.60
MIN_BM25 = 0.1
FUSION_K = 60
TOP_HITS = 5
K1, B, EPSILON = 1.5, 0.75, 0.25
DENSE, SPARSE = "hnsw", "bm25"
# Queries and documents per block: 128 MB of scores at most, and vectors to match.
DENSE_BLOCK = (1024, 16384)
SPARSE_BLOCK = (2048, 32768)
# Larger texts are dealt into tasks of so many stored bytes, though not into more than this (a join's estimate may be far too high).
TASK_TEXT, MAX_TASKS = 16 * 1024 * 1024, 4096
HIT_COLUMNS = ("signal_id", "query_no", "retriever", "rank", "doc_id", "score", "similarity", "distance")


# --- dense -----------------------------------------------------------------


def dense_topk(
    queries: DataFrame,
    docs: DataFrame | VectorIndex,
    group: str = "group_key",
    k: int = LIST_LENGTH,
    min_similarity: float = MIN_SIMILARITY,
    probes: int | None = vector_index.PROBES,
) -> DataFrame:
    """Cosine top-k per query among the documents of its group.

    Exact over documents; with a vector index, of its `probes` cells nearest to each query (exact if None).
    Dropping documents below the floor before ranking gives the same rows as ranking
    first, and keeps the lists short.
    """

    if isinstance(docs, VectorIndex):
        return vector_index.dense_topk(queries, docs, group, k, min_similarity, DENSE, probes)

    q = queries.filter(F.col("embedding").isNotNull()).select(
        "signal_id", "query_no", group, "embedding"
    )
    d = docs.filter(F.col("embedding").isNotNull()).select("doc_id", group, "embedding")
    grid = stored(block_grid(q, d, group, *DENSE_BLOCK), "grid")
    score = lambda qs, ds: vector_index.best_by_cosine(qs, ds, k, min_similarity, group)
    ranked = blocked_topk(q, d, grid, group, score, k, 2 * measured_bytes(grid))
    return ranked.select(
        "signal_id",
        "query_no",
        F.lit(DENSE).alias("retriever"),
        "rank",
        "doc_id",
        "score",
        half_even(F.col("score"), 4).alias("similarity"),
        (F.lit(1.0) - F.col("score")).alias("distance"),
    )


# --- BM25 ------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """BM25 tables of a whole corpus.

    `postings`: group, doc_id, n_tokens, term, tf. `terms`: term, df, idf.
    `stats`: one row with n_docs and mean_tokens.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    epsilon: float = EPSILON


def tokenized(docs: DataFrame, group: str = "group_key") -> DataFrame:
    """group, doc_id, n_tokens, words: the texts split once; a null text has no words.

    Stored, it serves everything below in place of the documents.
    """
    texts = spread_small(docs.select(group, "doc_id", "text"), "doc_id")
    words = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
    return texts.select(group, "doc_id", words.alias("words")).select(group, "doc_id", F.size("words").alias("n_tokens"), "words")


def _split(docs: DataFrame, group: str) -> DataFrame:
    return docs if "words" in docs.columns else tokenized(docs, group)


def postings(docs: DataFrame, group: str = "group_key") -> DataFrame:
    """Term frequency per (document, term) over the whole text.

    Texts move once, by document, and their words are counted where they arrive: a document's postings
    are several times as large as its text. Tasks hold about `TASK_TEXT` bytes of stored text.
    """
    if "words" not in docs.columns:
        docs = docs.select(group, "doc_id", "text")
        size = estimated_bytes(docs)
        if size > SMALL_BYTES:
            docs = docs.repartition(min(MAX_TASKS, max(docs.sparkSession.sparkContext.defaultParallelism, size // TASK_TEXT)), "doc_id")
    return _count_words(_doc_words(docs, group), group)


def _doc_words(docs: DataFrame, group: str) -> DataFrame:
    # outer, because a plain explode makes Spark split the text once more as a filter
    return _split(docs, group).select(group, "doc_id", "n_tokens", F.explode_outer("words").alias("term")).filter(
        F.col("term").isNotNull()
    )


def _count_words(words: DataFrame, group: str, *extra: str) -> DataFrame:
    return words.groupBy(group, "doc_id", "n_tokens", "term", *extra).agg(
        F.count(F.lit(1)).alias("tf")
    )


def document_frequency(docs: DataFrame) -> DataFrame:
    """Documents per term over the whole corpus; one count per document and term."""
    if "words" in docs.columns:
        terms = docs.select(F.explode(F.array_distinct("words")).alias("term"))
    else:
        words = F.array_distinct(tokens(F.col("text")))
        texts = spread_small(docs.select("doc_id", "text"), "doc_id")
        terms = texts.select(F.explode_outer(words).alias("term")).filter(F.col("term").isNotNull())
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and mean length in tokens."""
    n = F.count(F.lit(1))
    if "words" in docs.columns:
        lengths = docs.select("n_tokens")
    else:
        texts = spread_small(docs.select("doc_id", "text"), "doc_id")
        lengths = texts.select(F.size(tokens(F.col("text"))).alias("n_tokens"))
    return lengths.agg(
        n.alias("n_docs"), F.try_divide(F.sum("n_tokens"), n).alias("mean_tokens")
    )


def _idf(df: DataFrame, stats: DataFrame, epsilon: float) -> DataFrame:
    """Inverse document frequency; negative values get epsilon x the mean over all terms.

    `df` is read twice, so it should be a stored table where the corpus is large.
    """
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    rated = with_scalars(df, stats.select("n_docs")).select("term", "df", raw.alias("raw"))
    mean = rated.agg(F.avg("raw").alias("mean_raw"))
    weight = F.when(F.col("raw") < 0, F.col("mean_raw") * epsilon).otherwise(F.col("raw"))
    return with_scalars(rated, mean).select("term", "df", weight.alias("idf"))


def term_weights(docs: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Document frequency and weight of every term of the corpus."""
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return _idf(document_frequency(docs), stats, epsilon)


def bm25_index(docs: DataFrame, group: str = "group_key", epsilon: float = EPSILON) -> Index:
    """The tables as plans over the documents; `store_index` makes them permanent."""
    return Index(postings(docs, group), term_weights(docs, epsilon), corpus_stats(docs), epsilon)


def store_index(index: Index, root: str, group: str = "group_key") -> None:
    """Write an index below `root`, postings laid out so that a word's rows lie together.

    Document frequencies then come from the stored postings, so the texts are split
    into words once for them and once for the lengths.
    """
    spark = index.postings.sparkSession
    (
        index.postings.repartition(F.col("term"), F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        .sortWithinPartitions("term", group)
        .write.mode("error").parquet(f"{root}/postings")
    )
    index.stats.withColumn("epsilon", F.lit(index.epsilon)).write.mode("error").parquet(f"{root}/stats")
    stored = spark.read.parquet(f"{root}/postings")
    df = stored.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    _idf(df, spark.read.parquet(f"{root}/stats"), index.epsilon).write.mode("error").parquet(f"{root}/terms")


def load_index(spark: SparkSession, root: str) -> Index:
    postings_, terms, stats = (spark.read.parquet(f"{root}/{t}") for t in ("postings", "terms", "stats"))
    return Index(postings_, terms, stats.select("n_docs", "mean_tokens"), stats.first()["epsilon"])


def query_terms(queries: DataFrame, group: str = "group_key") -> DataFrame:
    """Distinct words of each query with their count; repeated words count repeatedly."""
    return (
        queries.select(
            "signal_id", "query_no", group, F.explode(tokens(F.col("text"))).alias("term")
        )
        .groupBy("signal_id", "query_no", group, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def asked_postings(
    source: DataFrame | Index, queries: DataFrame, group: str = "group_key", k1: float = K1, b: float = B
) -> DataFrame:
    """Length-normalised term frequency of the words asked for in each group.

    `queries` holds rows of (group, term); `source` is an index or the documents
    themselves. Words nobody asks for in a group are dropped before the first
    shuffle, so what moves is a small part of the corpus.
    """
    asked = queries.select(group, "term").distinct()
    bound = measured_bytes(asked)
    if isinstance(source, Index):
        counted, stats = attach(source.postings, asked, [group, "term"], "inner", bound=bound), source.stats
    else:
        words = attach(_doc_words(source, group), asked, [group, "term"], "inner", bound=bound)
        counted, stats = _count_words(words, group), corpus_stats(source)
    length = F.col("n_tokens") / F.col("mean_tokens")
    saturated = F.col("tf") * (k1 + 1) / (F.col("tf") + (F.lit(1 - b) + length * b) * k1)
    return with_scalars(counted, stats).select(group, "doc_id", "term", saturated.alias("weight"))


def weighted_terms(
    source: DataFrame | Index, queries: DataFrame
) -> DataFrame:
    """Query words times their inverse document frequency; unknown words drop out.

    The terms asked for are distinct before they meet the corpus's terms, so neither side has a hot key
    there; then their weights, a counted few bytes each, are attached to the words.
    """
    if isinstance(source, Index):
        terms = source.terms
    else:
        n_docs = source.agg(F.count(F.lit(1)).alias("n_docs"))
        terms = _idf(stored(document_frequency(source), "document-frequency"), n_docs, EPSILON)
    asked = queries.select("term").distinct()
    bound = 2 * measured_bytes(asked)
    idf = attach(terms.select("term", "idf"), asked, ["term"], "inner", bound=bound)
    return attach(queries, idf, ["term"], "inner", bound=bound).withColumn("qtf", F.col("qtf") * F.col("idf")).drop("idf")


def best_by_words(qs: pd.DataFrame, ds: pd.DataFrame, k: int, min_score: float) -> pd.DataFrame:
    """Best k documents of a block for each query: words (term, qtf) against items (doc_id, term, weight)."""
    ids, position = np.unique(ds["doc_id"].to_numpy(), return_inverse=True)
    weights = ds["weight"].to_numpy()
    lists = {term: (position[rows], weights[rows]) for term, rows in ds.groupby("term").indices.items()}
    out = [
        pd.DataFrame(
            {"signal_id": pd.Series(dtype=str), "query_no": pd.Series(dtype="int32"), "doc_id": ids[:0], "score": pd.Series(dtype=float)}
        )
    ]
    for (signal, number), words in qs.groupby(["signal_id", "query_no"], sort=False):
        total = np.zeros(len(ids))
        for term, count in sorted(zip(words["term"], words["qtf"])):
            if term in lists:
                where, weight = lists[term]
                total[where] += count * weight
        best = best_of_row(total, ids, k, min_score)
        if len(best):
            out.append(pd.DataFrame({"signal_id": signal, "query_no": number, "doc_id": ids[best], "score": total[best]}))
    return pd.concat(out[1:] or out, ignore_index=True)


def bm25_topk(
    queries: DataFrame,
    source: DataFrame | Index | TextIndex,
    group: str = "group_key",
    k: int = LIST_LENGTH,
    min_score: float = MIN_BM25,
) -> DataFrame:
    """BM25 top-k per query in its group; term statistics come from the whole corpus.

    `source` is an index of segments, a stored index, or documents when the corpus is searched only once; their
    texts are then split once, into a stored table.
    """
    words = query_terms(queries, group)
    if isinstance(source, TextIndex):
        ranked = source.topk(words.withColumnRenamed(group, "group_key"), k, min_score)
    else:
        if isinstance(source, DataFrame) and "words" not in source.columns:
            source = stored(tokenized(source, group), "tokenized")
        # several jobs read the query words: their weights, which take all words of the corpus, are computed once
        q, items = stored(weighted_terms(source, words), "weighted-words"), asked_postings(source, words, group)
        docs = source.postings.select(group, "doc_id").distinct() if isinstance(source, Index) else source
        grid = stored(block_grid(queries, docs, group, *SPARSE_BLOCK), "grid")
        ranked = blocked_topk(
            q, items, grid, group, lambda qs, ds: best_by_words(qs, ds, k, min_score), k, 2 * measured_bytes(grid), "term"
        )
    similarity = F.least(F.col("score") / 10.0, F.lit(1.0))
    return ranked.select(
        "signal_id",
        "query_no",
        F.lit(SPARSE).alias("retriever"),
        "rank",
        "doc_id",
        "score",
        half_even(similarity, 4).alias("similarity"),
        (F.lit(1.0) - similarity).alias("distance"),
    )


# --- fusion and scores -----------------------------------------------------


def fuse(hits: DataFrame, k: int = FUSION_K) -> DataFrame:
    """Reciprocal-rank fusion of all lists of a signal.

    Lists are ordered query by query, dense before sparse. A document keeps its best
    dense distance when any dense list holds it, else its best sparse distance. Equal
    scores keep the order of first appearance. The per-document arrays hold one entry
    per list, so their length is bounded by the number of lists.
    """
    list_no = F.col("query_no") * 2 + F.when(F.col("retriever") == SPARSE, 1).otherwise(0)
    grouped = (
        hits.withColumn("list_no", list_no)
        .groupBy("signal_id", "doc_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("list_no", "rank"))).alias("seen"),
            F.min(F.when(F.col("retriever") == DENSE, F.col("distance"))).alias("dense"),
            F.min(F.when(F.col("retriever") == SPARSE, F.col("distance"))).alias("sparse"),
        )
    )
    total = F.aggregate(
        F.transform("seen", lambda s: F.lit(1.0) / (s["rank"] + k)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    distance = F.coalesce("dense", "sparse")
    fused = grouped.select(
        "signal_id",
        "doc_id",
        total.alias("rrf_score"),
        distance.alias("distance"),
        half_even(F.lit(1.0) - distance, 4).alias("similarity"),
        F.when(F.col("dense").isNotNull(), DENSE).otherwise(SPARSE).alias("retriever"),
        F.col("seen")[0].alias("first_seen"),
    )
    w = Window.partitionBy("signal_id").orderBy(F.desc("rrf_score"), "first_seen", "doc_id")
    return fused.withColumn("fused_rank", F.row_number().over(w)).drop("first_seen")


def top_hits(fused: DataFrame, n: int = TOP_HITS) -> DataFrame:
    return fused.filter(F.col("fused_rank") <= n)


def search(
    queries: DataFrame,
    docs: DataFrame,
    group: str = "group_key",
    k: int = LIST_LENGTH,
    min_similarity: float = MIN_SIMILARITY,
    min_score: float = MIN_BM25,
    index: Index | TextIndex | None = None,
    vectors: VectorIndex | None = None,
) -> DataFrame:
    """All dense and sparse result lists of all signals, in one job.

    With a stored `index` the texts are not read again for the sparse half, with stored `vectors` the
    documents not for the dense half.
    """
    dense = dense_topk(queries, vectors or docs, group, k, min_similarity)
    sparse = bm25_topk(queries, index or docs, group, k, min_score)
    return dense.select(*HIT_COLUMNS).unionByName(sparse.select(*HIT_COLUMNS))


def lit_scores(signals: DataFrame, hits: DataFrame) -> DataFrame:
    """Literature score per signal; signals without hits get 0."""
    per_signal = hits.groupBy("signal_id").agg(
        F.avg(F.when(F.col("retriever") == DENSE, F.col("similarity"))).alias("_mean"),
        F.count(F.lit(1)).alias("_n"),
    )
    joined = signals.join(per_signal, "signal_id", "left")
    return joined.withColumns(
        {
            "n_hits": F.coalesce(F.col("_n"), F.lit(0)),
            "lit_score": scores.lit_score(F.col("_mean"), F.col("_n")),
        }
    ).drop("_mean", "_n")


def evidence_summary(signals: DataFrame, fused: DataFrame, n: int = 10) -> DataFrame:
    """Per signal: hits of each kind in the top n, their mean similarity, hits overall."""
    top = F.col("fused_rank") <= n
    counted = fused.groupBy("signal_id").agg(
        F.count_if(top & (F.col("retriever") == DENSE)).alias("hnsw_count"),
        F.count_if(top & (F.col("retriever") == SPARSE)).alias("bm25_count"),
        half_even(F.avg(F.when(top, F.col("similarity"))), 4).alias("avg_similarity"),
        F.count(F.lit(1)).alias("total_retrieved"),
    )
    zero = {"hnsw_count": 0, "bm25_count": 0, "avg_similarity": 0.0, "total_retrieved": 0}
    return signals.join(counted, "signal_id", "left").fillna(zero)


#: Preset: characters of a hit that the published evidence text shows.
PUBLISHED_HEAD_CHARS = 600


def evidence_block(signals: DataFrame, hits: DataFrame, docs: DataFrame, head_chars: int | None = None) -> DataFrame:
    """One text per signal: numbered header and text of each kept hit, whole unless `head_chars` is given.

    The sorted array holds the kept hits of one signal, at most `top_hits` of them.
    """
    texts = hits.join(docs.select("doc_id", "text"), "doc_id").select(
        "signal_id", "fused_rank", "doc_id", "similarity", (F.substring("text", 1, head_chars) if head_chars else F.col("text")).alias("head")
    )
    gathered = texts.groupBy("signal_id").agg(
        F.sort_array(
            F.collect_list(F.struct("fused_rank", "doc_id", "similarity", "head"))
        ).alias("h")
    )
    entry = F.transform(
        "h",
        lambda x, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] PMID:"), x["doc_id"].cast("string"),
            F.lit(" | similarity="), fixed(x["similarity"], 3), F.lit("\n"), x["head"],
        ),
    )
    block = F.coalesce(
        F.array_join(entry, "\n\n"),
        F.lit("No abstracts retrieved above similarity threshold."),
    )
    return signals.join(gathered, "signal_id", "left").withColumn("evidence", block).drop("h")


def spot_check(
    queries: DataFrame,
    docs: DataFrame,
    group: str = "group_key",
    min_similarity: float = MIN_SIMILARITY,
    need: int = 3,
    of: int = 5,
) -> DataFrame:
    """Per query: how many of the `of` nearest documents reach the floor, and whether enough do."""
    hits = dense_topk(queries, docs, group, k=of, min_similarity=-1.0)
    counted = hits.groupBy("signal_id", "query_no").agg(
        F.count_if(F.col("score") >= min_similarity).alias("n_above"),
        F.count(F.lit(1)).alias("n_found"),
    )
    joined = queries.select("signal_id", "query_no").join(
        counted, ["signal_id", "query_no"], "left"
    ).fillna({"n_above": 0, "n_found": 0})
    return joined.withColumn("ok", F.col("n_above") >= need)
