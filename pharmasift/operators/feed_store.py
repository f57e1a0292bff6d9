"""Feed pages by seeking: the feed stored in its order, a page read from where the last one ended.

The feed is range-partitioned and sorted by its order; a small table holds each range's last
position and size. A page needs the ranges from its start on that hold enough rows, so
a deep page reads as little as the first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmasift.functions import scores
from pharmasift.operators.storage import stored

def positions(by: str) -> list[Column]:
    """The columns of an order (see `review.FEED_ORDERS`), all ascending and never null."""
    def falling(name: str) -> Column:
        return -F.coalesce(F.col(name), F.lit(0)).cast("double")

    first = {
        "feed": lambda: [scores.tier_rank(F.col("priority")).cast("double"), falling("prr")],
        "priority": lambda: [scores.tier_rank(F.upper(F.coalesce("priority", F.lit("P4"))), 4).cast("double")],
        "prr": lambda: [falling("prr")],
        "cases": lambda: [falling("drug_reaction_count")],
        "deaths": lambda: [falling("death_count")],
    }
    return [*first[by](), F.coalesce("drug_key", F.lit("")), F.coalesce("pt", F.lit(""))]


@dataclass(frozen=True)
class FeedStore:
    spark: SparkSession
    path: str

    @classmethod
    def write(cls, feed: DataFrame, path: str, by: str = "feed", ranges: int = 64) -> FeedStore:
        """Store the feed (unique on drug and reaction) in about `ranges` ranges of its order."""
        names = [f"_at{i}" for i in range(len(positions(by)))]
        placed = stored(feed.withColumns(dict(zip(names, positions(by)))), "feed")
        dealt = placed.repartitionByRange(ranges, *names).withColumn("_range", F.spark_partition_id())
        dealt.sortWithinPartitions(*names).write.mode("error").partitionBy("_range").parquet(f"{path}/rows")
        rows = placed.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
        bounds = rows.groupBy("_range").agg(F.max(F.struct(*names)).alias("last"), F.count(F.lit(1)).alias("n"))
        bounds.coalesce(1).write.mode("error").parquet(f"{path}/bounds")
        placed.limit(0).drop(*names).write.mode("error").parquet(f"{path}/schema")
        return cls(placed.sparkSession, path)

    def page(self, limit: int, after: tuple | None = None) -> DataFrame:
        """The next `limit` rows after a position (the `_at` columns of the last row seen), in order."""
        bounds = self.spark.read.parquet(f"{self.path}/bounds").orderBy("_range").collect()  # a row for each range
        need, chosen, first = limit, [], True
        for b in bounds:
            if after is None or tuple(b["last"]) > after:
                chosen.append(b["_range"])
                need -= 0 if first and after is not None else b["n"]  # of the first range some rows are behind
                first = False
                if need <= 0:
                    break
        kinds = self.spark.read.parquet(f"{self.path}/rows") if bounds else self.spark.read.parquet(f"{self.path}/schema")
        if not bounds:
            return kinds
        names = [c for c in kinds.columns if c.startswith("_at")]
        rows = kinds.where(F.col("_range").isin(chosen))
        if after is not None:
            later = []
            for i, name in enumerate(names):
                same = [F.col(n) == v for n, v in zip(names[:i], after)]
                later.append(reduce(lambda x, y: x & y, [*same, F.col(name) > after[i]]))
            rows = rows.where(reduce(lambda x, y: x | y, later))
        return rows.orderBy(*names).limit(limit).drop("_range")

    @staticmethod
    def position(row) -> tuple:
        """Where a page ended, from its last row."""
        return tuple(row[c] for c in row.asDict() if c.startswith("_at"))
