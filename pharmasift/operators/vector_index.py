"""Inverted-file index of vectors: cells of near vectors, of which a query reads a few.

Cell centres are fitted by spherical k-means on a bounded sample. Every vector is stored
under the cell of its nearest centre; a query visits the cells nearest to it and ranks their
vectors by exact cosine. Visiting all cells gives the exact result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmasift.functions.rounding import half_even
from pharmasift.operators.blocks import best_of_row, block_grid, blocked_topk
from pharmasift.operators.joins import measured_bytes
from pharmasift.operators.storage import stored

#: Vectors that centres are fitted on at most, chosen by a hash of their id. All vectors are indexed.
SAMPLE = 100_000
#: Cells at most: the centres, a small matrix, go to every task.
MAX_CELLS = 16_384
ROUNDS = 10
#: Cells that a query visits.
PROBES = 8
#: Vectors and queries that meet in one task at most, about.
CELL_ROWS, QUERY_ROWS = 16_384, 1_024


def unit(batch: pa.Array) -> np.ndarray:
    """Rows of a list array as unit vectors from its flat buffer; vectors without a length become NaN."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(batch), -1) if len(batch) else flat.reshape(0, 0)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = np.nan
    return m / norms


def k_means(m: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centres of unit vectors; a cell left empty takes the vector farthest from its centre."""
    draw = np.random.default_rng(seed)
    centres = m[draw.choice(len(m), cells, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(m[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(m), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        own = np.einsum("ij,ij->i", m, centres[near])
        far = iter(np.argsort(own, kind="stable"))
        for c in np.flatnonzero(np.bincount(near, minlength=cells) == 0):
            sums[c] = m[next(far)]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres from at most `sample` vectors; by default about the square root of the number of vectors.

    Without a vector to learn from there is one cell, for everything.
    """
    known = vectors.where(F.col("embedding").isNotNull()).select("doc_id", "embedding")
    n = known.count()
    share = min(1.0, sample / n) if n else 1.0
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.where(hashed < share).select("embedding").limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 0))
    m = unit(rows.column(0).combine_chunks())
    m = m[~np.isnan(m).any(axis=1)]
    if not len(m):
        return np.zeros((1, 0))
    return k_means(m, max(1, min(cells or int(np.sqrt(n)), len(m), MAX_CELLS)), rounds)


def _cells(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """Adds `cell`, one row for each of the n nearest centres; vectors without a length have no place."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    names, at = [*df.columns, "cell"], df.columns.index("embedding")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = unit(batch.column(at))
            good = np.flatnonzero(~np.isnan(m).any(axis=1))
            if not len(good):
                continue
            centres = shared.value
            near = m[good] @ centres.T if centres.shape[1] else np.zeros((len(good), 1))
            k = min(n, near.shape[1])
            cells = np.argpartition(-near, k - 1, axis=1)[:, :k]
            rows = batch.take(pa.array(np.repeat(good, k)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells.ravel().astype(np.int32))], names=names)

    return df.mapInArrow(place, f"{fields}, cell int")


def _unit_rows(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = np.nan
    return m / norms


def best_by_cosine(qs: pd.DataFrame, ds: pd.DataFrame, k: int, min_similarity: float, group: str) -> pd.DataFrame:
    """Best k vectors of a block for each query of their group, by one matrix product a group."""
    ids, queries, items = ds["doc_id"].to_numpy(), _unit_rows(qs["embedding"]), _unit_rows(ds["embedding"])
    rows, places, scores = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    inside = ds.groupby(group).indices
    for g, asking in qs.groupby(group).indices.items():
        if g not in inside:
            continue
        at = inside[g]
        for row, found in zip(asking, np.nan_to_num(queries[asking] @ items[at].T, nan=-2.0)):
            best = best_of_row(found, ids[at], k, min_similarity)
            rows.append(np.full(len(best), row))
            places.append(at[best])
            scores.append(found[best])
    row, place = np.concatenate(rows), np.concatenate(places)
    return pd.DataFrame(
        {"signal_id": qs["signal_id"].to_numpy()[row], "query_no": qs["query_no"].to_numpy()[row], "doc_id": ids[place], "score": np.concatenate(scores)}
    )


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, path: str, group: str = "group_key", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Write (doc_id, group, embedding) below `path`, by cell. Null and zero vectors are left out: nothing is like them."""
        spark = vectors.sparkSession
        index = cls(spark, path, fit(vectors, cells, sample))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centres)], "cell int, centre array<double>").coalesce(1).write.mode(
            "error"
        ).parquet(f"{path}/centres")
        index._write(vectors, group, "error")
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        return cls(spark, path, np.array([r["centre"] for r in rows]))

    def add(self, vectors: DataFrame, group: str = "group_key") -> None:
        """Put further vectors into the same cells; stored ones are not read."""
        self._write(vectors, group, "append")

    def _write(self, vectors: DataFrame, group: str, mode: str) -> None:
        rows = vectors.where(F.col("embedding").isNotNull()).select("doc_id", F.col(group).alias("group_key"), "embedding")
        placed = _cells(rows, self.centres, 1)
        (
            placed.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
            .sortWithinPartitions("cell", "group_key")
            .write.mode(mode).partitionBy("cell").parquet(f"{self.path}/vectors")
        )
        rows.limit(0).write.mode("ignore").parquet(f"{self.path}/schema")

    def vectors(self) -> DataFrame:
        fields = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(fields.add("cell", "integer")).parquet(f"{self.path}/vectors")

    def topk(self, queries: DataFrame, k: int, min_similarity: float, group: str = "group_key", probes: int | None = PROBES) -> DataFrame:
        """signal_id, query_no, doc_id, score, rank; exact if `probes` is None, among the nearest cells otherwise.

        Queries and vectors of a cell meet in blocks of bounded size. Where all cells are read, those of a group are
        taken together: a query then goes to its group's blocks, not once to each cell.
        """
        asked = queries.where(F.col("embedding").isNotNull()).select(
            "signal_id", "query_no", F.col(group).cast("string").alias("group_key"), "embedding"
        )
        items = self.vectors().withColumn("group_key", F.col("group_key").cast("string"))
        if probes is None:
            q, by = asked, "group_key"
            items = items.drop("cell")
        else:
            q, by = stored(_cells(asked, self.centres, min(probes, len(self.centres))), "probed"), "cell"
            cells = [r[0] for r in q.select("cell").distinct().collect()]  # MAX_CELLS at most
            if len(cells) < len(self.centres):
                items = items.where(F.col("cell").isin(cells))
        grid = stored(block_grid(q, items, by, QUERY_ROWS, CELL_ROWS), "grid")
        score = lambda qs, ds: best_by_cosine(qs, ds, k, min_similarity, "group_key")
        return blocked_topk(q, items, grid, by, score, k, 2 * measured_bytes(grid))


def dense_topk(queries: DataFrame, index: VectorIndex, group: str, k: int, min_similarity: float, retriever: str, probes: int | None = PROBES) -> DataFrame:
    """The rows of an exact search, from the nearest cells only."""
    return index.topk(queries, k, min_similarity, group, probes).select(
        "signal_id", "query_no", F.lit(retriever).alias("retriever"), "rank", "doc_id", "score",
        half_even(F.col("score"), 4).alias("similarity"), (F.lit(1.0) - F.col("score")).alias("distance"),
    )
