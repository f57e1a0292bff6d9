"""Packing of tokenized documents into sequences of fixed capacity.

Hierarchical residual packing: every partition packs its pieces best-fit and gives up the
bins that are full or nearly so; the others become items themselves, are dealt into fewer
partitions and packed again, until few are left or packing no longer helps.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.llm.common import need, stored
from pharmasift.llm.encode import Words, bare_pieces, grouped

CAPACITY = 4096
END = 1
#: A bin with no more free tokens than this is given up as full.
SLACK = 8
#: Items that one task packs at most (a few numbers each).
TASK_ITEMS = 20_000
#: Another round must save this share of the bins that are not full.
GAIN = 0.01

PIECES = "row long, piece int, start long, length int, ids_crc32 long"


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ids, ended by `end`, cut into pieces of at most `capacity`.

    Returns id, row (a unique number of the document's row), piece, start, length and
    ids_crc32. Ids leave the worker as checksums only.
    """
    need(docs, id, text)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "row", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        words = Words(tokenizer, bare_pieces, packed_ids, b"".join)
        full = 4 * capacity
        for batch in batches:
            found: list[tuple] = []
            texts = batch.column(2).cast(pa.binary())
            open_row, held, piece = None, bytearray(), 0

            def emit(row, last):
                nonlocal piece
                if last:
                    held.extend(struct.pack("<I", end))
                while len(held) >= full or (last and held):
                    found.append((row, piece, piece * capacity, min(len(held), full) // 4, zlib.crc32(held[:full])))
                    del held[:full]
                    piece += 1
                if last:
                    piece = 0

            for group in grouped((i, t.as_py()) for i, t in enumerate(texts)):
                for (i, _), ids in zip(group, words.encode([part for _, part in group])):
                    if open_row is not None and i != open_row:
                        emit(open_row, True)
                    open_row = i
                    held.extend(ids)
                    emit(i, False)
            if open_row is not None:
                emit(open_row, True)
            row, *rest = zip(*found) if found else ((), (), (), (), ())
            at = pa.array(row, pa.int32())
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(at), batch.column(0).take(at), *(pa.array(x, k) for x, k in zip(rest, kinds))],
                names=names,
            )

    return rows.mapInArrow(cut, f"_id {id_type}, {PIECES}").withColumnRenamed("_id", id)


def best_fit(lengths: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, longest first into the fullest bin that still holds it.

    Open bins are kept by free space, and a bit mask of the spaces in use finds the
    tightest one in constant time.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, 0
    placed: list[tuple[int, int]] = [(0, 0)] * len(order)
    for i in order:
        n = lengths[i]
        fitting = used >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                used ^= 1 << free
        else:
            free, b = capacity, bins
            bins += 1
        placed[i] = (b, capacity - free)
        left = free - n
        if left:
            open_bins[left].append(b)
            used |= 1 << left
    return placed


def _round(items: DataFrame, tasks: int, capacity: int) -> DataFrame:
    """item, length -> item, bin (unique), at (offset in it), filled."""

    def pack(batches):
        held = [(b.column(0), b.column(1)) for b in batches]
        if not held:
            return
        items = pa.chunked_array([x for x, _ in held]).to_pylist()
        lengths = pa.chunked_array([x for _, x in held]).to_pylist()
        by_id = sorted(range(len(items)), key=items.__getitem__)  # the same result whatever the order of arrival
        items, lengths = [items[i] for i in by_id], [lengths[i] for i in by_id]
        placed = best_fit(lengths, capacity)
        filled: dict[int, int] = {}
        first: dict[int, int] = {}
        for item, n, (b, _) in zip(items, lengths, placed):
            filled[b] = filled.get(b, 0) + n
            first[b] = min(first.get(b, item), item)  # the smallest item of a bin names it
        columns = (items, [first[b] for b, _ in placed], [at for _, at in placed], [filled[b] for b, _ in placed])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(columns, kinds)], names=["item", "bin", "at", "filled"]
        )

    dealt = items.repartition(tasks, F.xxhash64("item", F.lit(tasks)))
    return dealt.mapInArrow(pack, "item long, bin long, at int, filled int")


def pack(pieces: DataFrame, item: str = "item", length: str = "length", capacity: int = CAPACITY, task_items: int = TASK_ITEMS) -> DataFrame:
    """sequence_id and offset for every row of a stored table of pieces.

    `item` is a unique long, `length` lies between 1 and `capacity`. Full pieces are
    sequences of their own. Each round is written to the shared folder; only row counts
    reach the driver. Rounds end when all items fit one task and were packed there, or
    when a round saves too little: then what is left stays spread over tasks.
    """
    need(pieces, item, length)
    full = F.col(length) >= capacity - SLACK
    items = pieces.where(~full).select(F.col(item).alias("item"), F.col(length).cast("int").alias("length"))
    home = None
    n = items.count()
    while n:
        tasks = max(1, -(-n // task_items))
        placed = stored(_round(items, tasks, capacity), "packed")
        home = placed.select("item", F.col("bin").alias("_bin"), F.col("at").alias("_at")) if home is None else stored(
            home.join(placed.select(F.col("item").alias("_bin"), "bin", "at"), "_bin", "left").select(
                "item", F.coalesce("bin", "_bin").alias("_bin"), (F.col("_at") + F.coalesce("at", F.lit(0))).alias("_at")
            ),
            "homes",
        )
        items = placed.where(F.col("filled") < capacity - SLACK).groupBy(F.col("bin").alias("item")).agg(F.first("filled").alias("length"))
        left = items.count()
        if tasks == 1 or left > n * (1 - GAIN):
            break
        n = left
    if home is None:
        return pieces.withColumns({"sequence_id": F.col(item), "offset": F.lit(0).cast("long")})
    home = home.withColumnsRenamed({"item": "_item", "_bin": "_sequence"})
    return (
        pieces.join(home, pieces[item] == home["_item"], "left")
        .withColumns(
            {
                "sequence_id": F.coalesce("_sequence", F.col(item)),
                "offset": F.coalesce("_at", F.lit(0)).cast("long"),
            }
        )
        .drop("_item", "_sequence", "_at")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Only documents longer than a sequence are
    cut. Rows with the same id are documents of their own. An empty table gives no
    rows; other columns of the input are not read.
    """
    cut = token_pieces(docs, tokenizer, capacity, end, id, text)
    pieces = stored(cut.withColumn("item", F.monotonically_increasing_id()).drop("row"), "pieces")
    return pack(pieces, capacity=capacity).select(
        id, "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )
