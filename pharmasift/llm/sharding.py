"""Shards that balance bytes, tokens and rows jointly.

Vector bin packing: groups of equal texts are placed one by one, largest first, into the bin where the
dot product of the group's sizes with the bin's residual capacity is highest. Tasks pack
their groups into bundles of equal capacity, bundles are the next round's items, and the last round, small
enough for one task, places what is left into the shards and evens them out by moving single items.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharmasift.llm.common import need, stored

SHARDS = 16
#: Items that one task places (three numbers each).
TASK_ITEMS = 20_000
#: Bundles that a task of an earlier round makes, for each shard.
BUNDLES = 64
#: A group over a shard's share in any dimension is split by row into so many parts for each share it holds.
PARTS = 4
#: Groups over this part of everything (so at most 3 * FREQUENT_PART) are looked up by broadcast, all others by join.
FREQUENT_PART = 1024
#: Rows numbered in one task, about.
NUMBERED_ROWS = 50_000

#: Loads of two shards in one dimension may differ by this part of a share before single items are moved.
EVEN = 0.0005

SIZES = ("bytes", "tokens", "rows")


def word_count(text: Column) -> Column:
    """Tokens of a text by default: runs of anything but white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def place(vectors: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each row of `vectors` (shares of the total, one column a dimension).

    Every bin starts with 1/bins of all rows' sum. Largest first; ties go to the first bin.
    """
    totals = vectors.sum(axis=0)
    scaled = vectors / np.where(totals > 0, totals, 1)
    residual = np.full((bins, vectors.shape[1]), 1.0 / bins)
    out = np.zeros(len(vectors), np.int32)
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        b = int(np.argmax(residual @ scaled[i]))
        out[i] = b
        residual[b] -= scaled[i]
    return out


def settle(vectors: np.ndarray, out: np.ndarray, bins: int, even: float = EVEN, steps: int = 500) -> np.ndarray:
    """Move or swap placed items between two bins, those that differ most first, while that brings them closer.

    With residuals r, moving w from bin a to b helps if w . (r_b - r_a) > w . w, and best if w is
    half of the difference; w is one item, or the difference of two. Ends when all bins are `even`
    or no two bins can be brought closer.
    """
    totals = vectors.sum(axis=0)
    scaled = vectors / np.where(totals > 0, totals, 1) * bins
    loads = np.zeros((bins, vectors.shape[1]))
    np.add.at(loads, out, scaled)
    members = [list(np.flatnonzero(out == b)) for b in range(bins)]
    pairs = [(a, b) for a in range(bins) for b in range(bins) if a < b]

    def move(a: int, b: int) -> bool:
        half = (loads[a] - loads[b]) / 2
        give, take = (np.vstack([np.zeros(vectors.shape[1]), scaled[members[x]]]) for x in (a, b))  # the first is nothing
        x = give - half
        far = (x * x).sum(axis=1)[:, None] + (take * take).sum(axis=1)[None, :] - 2 * x @ take.T
        i, j = np.unravel_index(far.argmin(), far.shape)
        if far[i, j] >= (half * half).sum() * 0.999:
            return False
        moved = give[i] - take[j]
        loads[a] -= moved
        loads[b] += moved
        given = [members[a].pop(i - 1)] if i else []
        members[a] += [members[b].pop(j - 1)] if j else []
        members[b] += given
        return True

    for _ in range(steps):
        if (loads.max(axis=0) - loads.min(axis=0)).max() <= even:
            break
        apart = [(((loads[a] - loads[b]) ** 2).sum(), a, b) for a, b in pairs]
        if not any(move(a, b) for far, a, b in sorted(apart, reverse=True) if far > even**2):
            break
    for b, ids in enumerate(members):
        out[ids] = b
    return out


def _round(items: DataFrame, tasks: int, bins: int) -> DataFrame:
    """item and sizes -> item, bin (unique over tasks) and the sizes again."""

    def pack(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("item")  # the same result whatever the order of arrival
        ids = table.column("item").to_numpy()
        vectors = np.stack([table.column(c).to_numpy().astype(float) for c in SIZES], axis=1)
        some = bins if tasks == 1 else max(1, min(bins, len(ids) // 8))  # every round must leave fewer items
        bins_of = place(vectors, some)
        if tasks == 1:
            bins_of = settle(vectors, bins_of, bins)
        else:  # the smallest item of a bundle names it
            first = np.full(some, np.iinfo(np.int64).max)
            np.minimum.at(first, bins_of, ids)
            bins_of = first[bins_of]
        columns = [pa.array(ids), pa.array(bins_of.astype(np.int64)), *(table.column(c).combine_chunks() for c in SIZES)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "bin", *SIZES])

    items = items.select("item", *SIZES)
    dealt = items.coalesce(1) if tasks == 1 else items.repartition(tasks, F.xxhash64("item", F.lit(tasks)))
    return dealt.mapInArrow(pack, "item long, bin long, bytes long, tokens long, rows long")


def assign(units: DataFrame, shards: int = SHARDS, task_items: int = TASK_ITEMS, bundles: int = BUNDLES) -> DataFrame:
    """item, shard for a stored table of item (a unique long), bytes, tokens, rows.

    Each round is written to the shared folder; only row counts reach the driver.
    """
    need(units, "item", *SIZES)
    items, home = units, None
    while True:
        tasks = max(1, -(-items.count() // task_items))
        bins = shards if tasks == 1 else shards * bundles
        placed = stored(_round(items, tasks, bins), "placed")
        step = placed.select(F.col("item").alias("_item"), F.col("bin").alias("_bin"))
        home = step if home is None else stored(
            home.withColumnRenamed("_bin", "_at").join(step.withColumnRenamed("_item", "_at"), "_at").select("_item", "_bin"), "homes"
        )
        if tasks == 1:
            return home.select(F.col("_item").alias("item"), F.col("_bin").cast("int").alias("shard"))
        items = placed.groupBy(F.col("bin").alias("item")).agg(*(F.sum(c).alias(c) for c in SIZES))


def units_of(rows: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The groups of a stored table of row, digest, bytes, tokens, rows, and the frequent ones among them.

    Units have digest, part (0, but for groups too large for one shard: by a hash of the row), item
    and their sizes. Frequent groups (digest, parts) hold 1/FREQUENT_PART of everything or more.
    """
    groups = stored(rows.groupBy("digest").agg(*(F.sum(c).alias(c) for c in SIZES)), "groups")
    totals = groups.agg(*(F.sum(c).alias(c) for c in SIZES)).first()
    share = F.greatest(*(F.col(c) / F.lit(float(totals[c] or 1)) for c in SIZES))
    parts = F.when(share * shards > 1, F.ceil(share * shards * PARTS)).otherwise(1).cast("int")
    frequent = stored(groups.where(share * FREQUENT_PART >= 1).select("digest", F.least(parts, F.col("rows")).cast("int").alias("parts")), "frequent")
    split = rows.join(F.broadcast(frequent.where("parts > 1")), "digest").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    whole = groups.join(F.broadcast(frequent.where("parts > 1")), "digest", "left_anti").select("digest", F.lit(0).alias("part"), *SIZES)
    units = whole.unionByName(split.groupBy("digest", "part").agg(*(F.sum(c).alias(c) for c in SIZES)))
    return stored(units.withColumn("item", F.monotonically_increasing_id()), "units"), frequent


def numbered(rows: DataFrame, shard: str = "shard", order: str = "row", per_task: int = NUMBERED_ROWS) -> DataFrame:
    """`slot` from 0 in every shard, without a gap.

    Rows are dealt into numbered buckets; a shard's buckets follow each other. One task numbers the rows of one
    shard and bucket, another adds up the sizes of a shard's buckets.
    """
    buckets = max(1, rows.count() // per_task)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sizes = dealt.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(shard, "_bucket").orderBy(order)
    return (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .join(starts, [shard, "_bucket"])
        .withColumn("slot", F.col("_start") + F.col("_own"))
        .drop("_bucket", "_start", "_own")
    )


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", tokens: Callable[[Column], Column] | str = word_count,
    task_items: int = TASK_ITEMS, per_task: int = NUMBERED_ROWS,
) -> DataFrame:
    """One row per document: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), tokens.

    Size is the text's UTF-8 bytes plus 1; tokens are words, or the column named by `tokens`. Rows of equal texts (null is
    equal to empty) share a shard, unless their group exceeds a shard's whole share of the bytes, tokens or rows: then its
    rows are dealt into parts of about a quarter share. Sizes of shards are near equal as far as single rows
    allow. Texts don't leave the scan: rows travel as a 32-byte digest and a few numbers. Rows that share an id or have none are
    rows of their own; an empty table gives no rows; other columns are not read.
    """
    need(docs, id, text, *([tokens] if isinstance(tokens, str) else []))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(body, 256)).alias("digest"),
            F.crc32(body.cast("binary")).alias("crc"),
            (F.octet_length(body) + 1).cast("long").alias("bytes"),
            F.coalesce(F.col(tokens) if isinstance(tokens, str) else tokens(body), F.lit(0)).cast("long").alias("tokens"),
            F.lit(1).cast("long").alias("rows"),
        ),
        "sized",
    )
    units, frequent = units_of(rows, shards)
    homes = units.join(assign(units, shards, task_items), "item").select("digest", "part", "shard")
    frequent_homes = stored(homes.join(F.broadcast(frequent), "digest"), "frequent-homes")
    marked = rows.join(F.broadcast(frequent), "digest", "left").withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(0).cast("int")
    )
    large = marked.where("parts IS NOT NULL").join(F.broadcast(frequent_homes.select("digest", "part", "shard")), ["digest", "part"])
    other = marked.where("parts IS NULL").join(homes.join(F.broadcast(frequent), "digest", "left_anti").drop("part"), "digest")
    columns = ["id", "row", "crc", "bytes", "tokens", "shard"]
    placed = stored(large.select(columns).unionByName(other.select(columns)), "sharded")
    return numbered(placed, per_task=per_task).select(
        F.col("id").alias(id), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
