"""Join helpers that stay safe when a key is hot or a side grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 32 * 1024 * 1024
#: Tables below this are moved freely.
SMALL_BYTES = 8 * BROADCAST_LIMIT


def estimated_bytes(df: DataFrame) -> int:
    """Size of the result as Catalyst estimates it, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: What an estimate is multiplied by: files are compressed, and texts count as 20 bytes in it.
EXPANSION = 8


def measured_bytes(df: DataFrame) -> int:
    """Bytes that the rows take in memory, counted by running the plan: for small look-ups only."""
    sizes = [
        F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16) for c, kind in df.dtypes
    ]
    row = F.lit(32)
    for size in sizes:
        row = row + size
    return df.agg(F.sum(row)).first()[0] or 0


def trusted_bytes(df: DataFrame) -> int | None:
    """A cautious size without running anything; None if the plan multiplies rows, which no estimate sees."""
    if "Generate " in df._jdf.queryExecution().optimizedPlan().toString():
        return None
    return estimated_bytes(df) * EXPANSION


def lookup_bytes(df: DataFrame, limit: int = BROADCAST_LIMIT) -> int:
    """`trusted_bytes` where they settle it; else the look-up is counted: an aggregate is estimated as large as its input."""
    size = trusted_bytes(df)
    return size if size is not None and size <= limit else measured_bytes(df)


#: Input of one task where rows are dealt by a key, as the files' bytes: memory of a task does not grow with the input.
TASK_BYTES = 16 * 1024 * 1024


def task_count(*inputs: DataFrame) -> int:
    """Tasks that give each about TASK_BYTES of the largest input, at least one per core.

    The files below a plan are summed, as joins are estimated as products. Where an input has no known size, the
    session's number of shuffle partitions is the least.
    """
    session = inputs[0].sparkSession
    tasks = session.sparkContext.defaultParallelism
    for df in inputs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        known = size < 1 << 60  # Spark's size of rows that no file holds
        tasks = max(tasks, -(-size // TASK_BYTES) if known else int(session.conf.get("spark.sql.shuffle.partitions")))
    return tasks


def shuffle_count(df: DataFrame) -> int:
    """Shuffles by a key that the plan has."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def dealt(rows: DataFrame, tasks: int, key: str = "primaryid") -> DataFrame:
    """Rows with a key, shuffled on it once: grouping and joining by it needs no other shuffle among tables dealt to as many tasks."""
    return rows.filter(F.col(key).isNotNull()).repartition(tasks, key)


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    limit: int = BROADCAST_LIMIT,
    salts: int = 32,
    bound: int | None = None,
) -> DataFrame:
    """Join a large side to a look-up side, usually unique on `on`; otherwise a fact meets each of its look-up rows.

    The look-up is broadcast only while its size stays under `limit`. The size is
    `bound`, which the caller has measured, or else a cautious multiple of Catalyst's
    estimate. Beyond the limit both sides are shuffled on the key plus a salt: fact rows of a hot
    key spread over `salts` tasks and the look-up is repeated once per salt. Fact
    rows with the same content may share a salt; no row is lost or doubled because
    every salt meets exactly one copy of each look-up row.
    """
    size = trusted_bytes(lookup) if bound is None else bound
    if size is not None and size <= limit:
        return facts.join(F.broadcast(lookup), on, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def spread_small(df: DataFrame, key: str, limit: int = SMALL_BYTES) -> DataFrame:
    """Give a small table to all cores before heavy per-row work.

    A small file is one scan task, however long the work per row takes. Below `limit`
    bytes moving the rows is cheap; a larger table has enough scan tasks already and
    stays where it is.
    """
    if estimated_bytes(df) > limit:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Put the columns of a one-row DataFrame on every row.

    The right side is reduced to one row here (it must have one; of several, any would be
    kept), so its size does not depend on what the caller passes; that makes the broadcast safe.
    """
    one = scalars.agg(*(F.first(c).alias(c) for c in scalars.columns))
    return df.crossJoin(F.broadcast(one))


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null distinct keys, combined before the shuffle, for semi and anti joins."""
    return df.select(*keys).dropna().distinct()
