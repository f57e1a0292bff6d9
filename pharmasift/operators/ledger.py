"""Token and cost accounting over call rows (call_id, day, task, input_tokens, output_tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharmasift.operators.joins import with_scalars

# Price per thousand tokens, daily budget.
INPUT_PER_1K = "0.00015"
OUTPUT_PER_1K = "0.00060"
DAILY_BUDGET = "10.00"
MONEY = "decimal(18,8)"
#: Keys that the cuts of a running sum are chosen from at most.
CUT_SAMPLE = 20_000


def call_cost(
    input_tokens: Column, output_tokens: Column, input_price: str = INPUT_PER_1K, output_price: str = OUTPUT_PER_1K
) -> Column:
    """Exact decimal cost of one call."""
    def part(tokens: Column, price: str) -> Column:
        return tokens.cast("decimal(12,0)") * F.lit(price).cast("decimal(9,8)") / F.lit(1000).cast("decimal(4,0)")

    return (part(input_tokens, input_price) + part(output_tokens, output_price)).cast(MONEY)


def with_cost(calls: DataFrame, prices: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Add `cost`; `prices` has (input, output) per thousand tokens for tasks that don't have the default price."""
    tokens = F.col("input_tokens"), F.col("output_tokens")
    cost = call_cost(*tokens)
    for task, price in (prices or {}).items():
        cost = F.when(F.col("task") == task, call_cost(*tokens, *price)).otherwise(cost)
    return calls.withColumn("cost", cost)


def usage_by_task(calls: DataFrame, prices: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    costed = with_cost(calls, prices)
    return costed.groupBy("task").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("total_tokens"),
        F.count(F.lit(1)).alias("total_calls"),
        F.sum("cost").cast(MONEY).alias("total_cost"),
    )


def spend_by_day(calls: DataFrame, budget: str = DAILY_BUDGET, prices: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    limit = F.lit(budget).cast(MONEY)
    daily = with_cost(calls, prices).groupBy("day").agg(F.sum("cost").cast(MONEY).alias("spent"))
    return daily.withColumns(
        {"remaining": (limit - F.col("spent")).cast(MONEY), "over_budget": F.col("spent") > limit}
    )


def running_spend(
    calls: DataFrame, budget: str = DAILY_BUDGET, order: tuple[str, ...] = ("call_id",), runs: int = 200,
    prices: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Spend of the day up to and including each call, in the order of the given columns.

    A day may hold a large share of all calls, so one window per day would put them on
    one task. Calls are cut into about `runs` equal parts of the whole order key (any sortable types; calls
    of one time are told apart by the next column) instead: a window inside each part, plus the sum of the day's earlier
    parts, which is a small aggregate with one row per day and part. The cuts come from CUT_SAMPLE keys
    at most, chosen by hash; they decide about sizes only.
    """
    limit = F.lit(budget).cast(MONEY)
    place = F.struct(*order)
    sample = calls.select(place.alias("_k")).orderBy(F.xxhash64(*order)).limit(CUT_SAMPLE).agg(F.array_sort(F.collect_list("_k")).alias("_s"))
    steps = F.sequence(F.lit(1), F.lit(max(1, runs - 1)))
    cuts = sample.select(F.transform(steps, lambda n: F.get("_s", (n * F.size("_s") / runs).cast("int"))).alias("_cuts"))
    run = F.size(F.filter("_cuts", lambda c: c < place))
    costed = with_scalars(with_cost(calls, prices), cuts).withColumn("_run", run).drop("_cuts")
    per_run = costed.groupBy("day", "_run").agg(F.sum("cost").alias("_sum"))
    earlier = Window.partitionBy("day").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select(
        "day", "_run", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("day", "_run").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = costed.withColumn("_local", F.sum("cost").over(inside))
    spent = (F.col("_before").cast(MONEY) + F.col("_local").cast(MONEY)).cast(MONEY)
    return (
        local.join(offsets, ["day", "_run"])
        .withColumn("spent", spent)
        .withColumn("over_budget", F.col("spent") > limit)
        .drop("_run", "_local", "_before")
    )
