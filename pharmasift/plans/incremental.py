"""Signals kept up to date by differences: a batch of reports changes only the counts it touches.

    current   caseid, caseversion, primaryid      by batch: the newest versions it brought
    pairs     the marked pairs of these reports   by batch and hash bucket of the report
    cells     signed partial cells                by batch: its pairs added, superseded ones taken back

A new batch looks up the known versions of its own cases. Pairs of the reports it supersedes are read from
their batch and bucket and subtracted; all other pairs stay unread. Signals are computed from
the sums of the cells alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmasift.operators import disproportionality as dp
from pharmasift.operators import temporal
from pharmasift.operators.cases import best_row, latest_version
from pharmasift.operators.joins import task_count
from pharmasift.operators.pairs import build_newest
from pharmasift.operators.storage import stored
from pharmasift.plans.flagging import flag_partials

BUCKETS = 32


def _bucket(id: Column) -> Column:
    return F.pmod(F.xxhash64(id.cast("string")), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class SignalState:
    """The stored state below `root`; `batches` are those added so far, as the folder of cells shows."""

    spark: SparkSession
    root: str

    def _read(self, name: str) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}") if store.exists(folder) else None

    def _known(self, batch: str) -> DataFrame | None:
        """All versions that other batches brought."""
        rows = self._read("current")
        return None if rows is None else rows.where(F.col("batch").cast("string") != batch)

    def add(self, batch: str, demo: DataFrame, drug: DataFrame, reac: DataFrame, outc: DataFrame, name_map: DataFrame, roles: Sequence[str] = ("PS",)) -> None:
        """Take in the reports of a batch with all their drugs, reactions and outcomes.

        Adding the last batch again, after a failure or not, replaces what it wrote. A version that is older than the known one of its case
        changes nothing. Null batches or cases are values like any other; an empty batch changes nothing.
        """
        newest = latest_version(demo)
        known = self._known(batch)
        superseded = None
        if known is not None:
            cases = newest.select(F.col("caseid").alias("_case")).distinct()
            own = known.join(cases, known["caseid"].eqNullSafe(cases["_case"]), "left_semi")
            rank = own.withColumn("batch", F.col("batch").cast("string"))
            before = stored(best_row(rank, ["caseid"], ["caseversion", "primaryid"]), "known-versions")
            old = before.select(
                F.col("caseid").alias("_case"), F.struct("caseversion", "primaryid").alias("_old"), F.col("primaryid").alias("_id"),
                F.col("batch").alias("_batch"),
            )
            joined = newest.join(old, newest["caseid"].eqNullSafe(old["_case"]), "left")
            fresh = joined.where(F.col("_old").isNull() | (F.struct("caseversion", "primaryid") > F.col("_old")))
            newest = stored(fresh, "fresh-versions")
            superseded = newest.where(F.col("_old").isNotNull()).select(F.col("_id").alias("primaryid"), F.col("_batch").alias("batch"))
            newest = newest.drop("_case", "_old", "_id", "_batch")
        pairs = build_newest(newest, drug, reac, outc, name_map, roles, marks=True)
        parts = -(-task_count(newest, drug, reac, outc) // BUCKETS)  # files of a bucket, so that none grows with the batch
        part = F.pmod(F.xxhash64("primaryid"), F.lit(parts))
        (
            pairs.withColumn("bucket", _bucket(F.col("primaryid"))).repartition(parts * BUCKETS, "bucket", part)
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/pairs/batch={batch}")
        )
        added = self.spark.read.schema(pairs.schema).parquet(f"{self.root}/pairs/batch={batch}")
        cells = dp.partial_cells(added)
        if superseded is not None and not superseded.isEmpty():
            cells = cells.unionByName(dp.partial_cells(self._pairs_of(superseded, added.columns), -1))
        cells.write.mode("overwrite").parquet(f"{self.root}/cells/batch={batch}")
        newest.select("caseid", "caseversion", "primaryid").write.mode("overwrite").parquet(f"{self.root}/current/batch={batch}")

    def _pairs_of(self, reports: DataFrame, columns: list[str]) -> DataFrame:
        """Stored pairs of some reports (primaryid, batch), from their batches and buckets only."""
        places = reports.select("batch", _bucket(F.col("primaryid")).alias("bucket")).distinct()
        batches = [r[0] for r in places.select("batch").distinct().collect()]  # as many as there are folders
        buckets = [r[0] for r in places.select("bucket").distinct().collect()]  # BUCKETS at most
        pairs = self._read("pairs").withColumn("batch", F.col("batch").cast("string"))
        near = pairs.where(F.col("batch").isin(batches) & F.col("bucket").isin(buckets))
        return near.join(reports, ["primaryid", "batch"], "left_semi").select(columns)

    def partials(self) -> DataFrame:
        """The sums of all signed cells."""
        return self._read("cells").groupBy("drug_key", "pt", "source_quarter").agg(*(F.sum(c).alias(c) for c in dp.PARTIAL_SUMS)).where("n_rows <> 0")

    def signals(
        self, limits: dp.Thresholds, junk: DataFrame | Sequence[str] = dp.JUNK_TERMS,
        spike_max: float | None = temporal.SPIKE_MAX_SHARE, late_periods: Sequence[str] = temporal.LATE_PERIODS,
        late_max: float | None = temporal.LATE_MAX_SHARE,
    ) -> DataFrame:
        return flag_partials(stored(self.partials(), "partials"), limits, junk, spike_max, late_periods, late_max)
