"""Top-k of queries against items of the same group, in bounded blocks.

A group (one drug's literature, say) can hold a large share of all rows. Queries and
items of a group are therefore cut into blocks by hash; every (query block, item
block) combination is one task-sized unit that scores its part with numpy and hands
on at most k rows per query. A last ranking merges the partial lists. The result is
the exact top-k; candidate pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pharmasift.operators.joins import attach, measured_bytes
from pharmasift.operators.storage import stored

RESULT = "signal_id string, query_no int, doc_id {id_type}, score double"


def block_grid(
    queries: DataFrame, docs: DataFrame, group: str, query_rows: int, item_rows: int
) -> DataFrame:
    """Block counts per group that has both queries and documents; one short row per group.

    Only the group columns are read; rows combine before the shuffle.
    """
    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    return blocks(queries, query_rows, "_nq").join(blocks(docs, item_rows, "_ni"), group)


def _place(
    rows: DataFrame, grid: DataFrame, group: str, keys: list[str], own: str, other: str, bound: int
) -> DataFrame:
    """Hash rows to their own block number and repeat them over the other side's blocks."""
    placed = attach(rows, grid, [group], "inner", bound=bound)
    return placed.withColumns(
        {
            f"_b{own}": F.pmod(F.xxhash64(*keys), F.col(f"_n{own}")).cast("int"),
            f"_b{other}": F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)),
        }
    ).drop("_nq", "_ni")


def best_of_row(scores: np.ndarray, ids: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Positions of the k best scores >= floor, best first, ties by ascending id.

    Scores are compared at nine decimals so that equal texts tie in spite of
    floating-point noise.
    """
    hits = np.flatnonzero(scores >= floor)
    if len(hits) > k:
        cut = np.partition(scores[hits], len(hits) - k)[len(hits) - k]
        hits = hits[scores[hits] >= cut - 1e-8]
    _, rank = np.unique(ids[hits], return_inverse=True)  # ids may be texts
    order = np.lexsort((rank, -np.round(scores[hits], 9)))
    return hits[order[:k]]


def blocked_topk(
    queries: DataFrame,
    items: DataFrame,
    grid: DataFrame,
    group: str,
    score_block: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    k: int,
    bound: int,
    word: str | None = None,
) -> DataFrame:
    """Ranked top-k rows (signal_id, query_no, doc_id, score, rank).

    `grid` comes from `block_grid` and holds one short row per group that has a
    query; `bound` is the counted size of these rows in bytes. With `word`, a column of both sides, an item goes
    only to the query blocks that ask for its word, not to all of its group.
    """
    q = _place(queries, grid, group, ["signal_id", "query_no"], "q", "i", bound)
    if word is None:
        i = _place(items, grid, group, ["doc_id"], "i", "q", bound)
    else:
        # words go to Python as numbers: a block's memory is then a few numbers for each of its items
        numbered = stored(queries.select(word).distinct().withColumn("_word", F.monotonically_increasing_id()), "words")
        size = measured_bytes(numbered)
        q = attach(q, numbered, [word], "inner", bound=size).drop(word).withColumnRenamed("_word", word)
        own = attach(queries, grid, [group], "inner", bound=bound)
        number = F.pmod(F.xxhash64("signal_id", "query_no"), F.col("_nq")).cast("int").alias("_bq")
        asked = attach(own.select(group, word, number).distinct(), numbered, [word], "inner", bound=size)
        item = F.pmod(F.xxhash64("doc_id"), F.col("_ni")).cast("int")
        placed = attach(items, grid, [group], "inner", bound=bound).withColumn("_bi", item).drop("_nq", "_ni")
        i = attach(placed, asked, [group, word], "inner", bound=2 * measured_bytes(asked)).drop(word).withColumnRenamed("_word", word)
    keys = [group, "_bq", "_bi"]

    def run(qs: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or docs.empty:
            return pd.DataFrame(
                {"signal_id": pd.Series(dtype=str), "query_no": pd.Series(dtype="int32"),
                 "doc_id": docs["doc_id"].iloc[:0], "score": pd.Series(dtype=float)}
            )
        return score_block(qs, docs)

    partial = q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(
        run, RESULT.format(id_type=items.schema["doc_id"].dataType.simpleString())
    )
    return rank_lists(partial, k)


def rank_lists(scored: DataFrame, k: int) -> DataFrame:
    """1-based rank inside each (signal, query) list and the best k of it."""
    w = Window.partitionBy("signal_id", "query_no").orderBy(
        F.round("score", 9).desc(), F.col("doc_id")
    )
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
