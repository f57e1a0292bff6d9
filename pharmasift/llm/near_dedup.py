"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidates, exact checks.

Documents with equal shingle sets form a class; from there on one node stands for the
class. Nodes that share a band fall into a bucket, and all members of a bucket are compared
with its centre only. The buckets with the same centre make up its star. Stars whose
members the verified links already join are finished. In the others, the members outside the
largest component are compared with all members, block by block: a task compares the sets
of two blocks of bounded size and returns at most one link per two components, so that no
link inside a star is lost and no list of pairs is ever made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.llm.common import need, small, stored
from pharmasift.llm.components import components
from pharmasift.llm.encode import GROUP_BYTES, slices

WORDS = 5
SIMILARITY = 80  # per cent
#: At 80 % similarity a pair shares no bucket with probability (1 - 0.8**6)**32 = 6e-5, at 85 % 2e-7.
BANDS, ROWS = 32, 6
#: Shingles in a block of sets that are compared with another block: few at first, so that a star
#: is spread over up to BLOCKS blocks a side, then more, up to what a task holds easily.
BLOCK, BLOCKS, LARGE_BLOCK = 64_000, 64, 1_000_000
#: Sets a side that are compared at once within two blocks: short sets make a block of many.
SIDE = 2_048

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(_U)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(31))


def odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) | _U(1)


class Shingles:
    """Distinct hashed word shingles of texts."""

    def __init__(self, words: int):
        self.k = words
        self.codes = odd(256, 1)
        a, z = ord("A"), ord("Z")
        self.codes[a : z + 1] = self.codes[a + 32 : z + 33]  # lower case
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(9, 14)]] = True
        self.factors = odd(words, 2)
        self.power = self.inverse = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base = 0x9E3779B97F4A7C15
            back = pow(base, -1, 1 << 64)
            for name, b in (("power", base), ("inverse", back)):
                steps = np.full(n, b, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def word_hashes(self, text: bytes) -> np.ndarray:
        """One number per word [^\\x20\\x09-\\x0D]+, read from prefix sums of a polynomial."""
        found = []
        for part in slices(text):
            if not part:
                continue
            buf = np.frombuffer(part, np.uint8)
            edge = np.flatnonzero(np.diff(self.space[buf].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
            start, end = edge[::2], edge[1::2]
            self._powers(len(buf))
            sums = np.zeros(len(buf) + 1, _U)
            np.cumsum(self.codes[buf] * self.power[: len(buf)], out=sums[1:])
            found.append(mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(_U)))
        return np.concatenate(found) if found else np.zeros(0, _U)

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingles; of fewer words than a shingle has, the whole sequence."""
        w = self.word_hashes(text)
        if not len(w):
            return w
        k = min(self.k, len(w))
        total = np.full(len(w) - k + 1, k, _U)
        for j in range(k):
            total += w[j : len(w) - k + 1 + j] * self.factors[j]
        return np.unique(mix(total))


class Signatures:
    """One-permutation MinHash with optimal densification, folded into band keys."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, n = bands, rows, bands * rows
        self.edges = np.array([-(-(i << 64) // n) for i in range(n)], dtype=_U)
        self.factors, self.offsets = odd(rows, 3), odd(bands, 4)
        self.bins = np.arange(n, dtype=_U)

    def _donors(self, first: int, last: int, bins: np.ndarray) -> np.ndarray:
        """The bins that an empty bin asks in turn: a hash of bin and attempt, the same for all sets."""
        attempt = np.arange(first, last, dtype=_U)[:, None] << _U(32)
        return (mix(attempt + bins[None, :].astype(_U)) % _U(len(self.bins))).astype(np.int64)

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        at = np.append(np.searchsorted(shingles, self.edges), len(shingles))
        filled = at[1:] > at[:-1]
        values = shingles[np.minimum(at[:-1], len(shingles) - 1)]
        empty, first, last = np.flatnonzero(~filled), 0, 8
        while len(empty):
            donors = self._donors(first, last, empty)
            hit = filled[donors]
            got, which = hit.any(0), hit.argmax(0)
            values[empty[got]] = values[donors[which[got], np.flatnonzero(got)]]
            empty, first, last = empty[~got], last, last * 8
            last = min(last, first + 4096)
        rows = mix(values).reshape(self.bands, self.rows) * self.factors
        return mix(rows.sum(1, dtype=_U) + self.offsets).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int, id: str, text: str) -> DataFrame:
    """id, n_shingles, hi and lo (128-bit name of the set, null if empty) and bands."""
    read = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = read.schema["id"].dataType.simpleString()

    def sign(batches):
        make, fold = Shingles(words), Signatures(bands, rows)
        for batch in batches:
            n, names, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = make.of(text.as_py())
                n.append(len(s))
                names.append(set_name(s) if len(s) else (None, None))
                keys.append(fold.bands_of(s) if len(s) else s.view(np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64())
            )
            hi, lo = zip(*names) if names else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists],
                names=["id", "n_shingles", "hi", "lo", "bands"],
            )

    return read.mapInArrow(sign, f"id {kind}, n_shingles long, hi long, lo long, bands array<long>")


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    hi, lo = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)
    return int(hi), int(lo)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """hi, lo, shingles of each text."""

    def sets(batches):
        make = Shingles(words)
        for batch in batches:
            rows, size = [], 0
            for text in batch.column(0).cast(pa.binary()):
                rows.append(make.of(text.as_py()).view(np.int64))
                size += len(rows[-1])
                if size > GROUP_BYTES:
                    yield as_batch(rows)
                    rows, size = [], 0
            if rows:
                yield as_batch(rows)

    def as_batch(rows):
        hi, lo = zip(*map(set_name, rows))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists], names=["hi", "lo", "shingles"])

    return docs.mapInArrow(sets, "hi long, lo long, shingles array<long>")


def _linked(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; pairs of unlike sizes need no look at them."""
    def of(table, end):
        return table.select(*(F.col(c).alias(end if c == "node" else f"{c}_{end}") for c in table.columns))

    close = (
        pairs.join(of(sizes, "a"), "a").join(of(sizes, "b"), "b")
        .where(f"100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
        .select("a", "b")
    )
    both = close.join(of(sets, "a"), "a").join(of(sets, "b"), "b")
    shared = both.select(
        "a", "b", F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long").alias("x"),
        (F.size("shingles_a") + F.size("shingles_b")).cast("long").alias("y"),
    )
    return shared.where(f"100 * x >= {similarity} * (y - x)").select("a", "b")


def links(
    docs: DataFrame, classes: DataFrame, buckets: DataFrame, words: int, similarity: int, id: str, text: str, block: int
) -> DataFrame:
    """Components (node, root) of the verified links between the nodes of the buckets."""
    ends = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    pairs = stored(
        buckets.join(stored(ends.select("key", "centre"), "crowded"), "key").where("node <> centre")
        .select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(),
        "stars",
    )
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(ends.join(classes, "node").select("node", F.col("rep").alias("_rep"), "hi", "lo", "n"), "wanted")
    reps = wanted.select("_rep")
    if small(reps):
        reps = F.broadcast(reps)
    texts = docs.join(reps, docs[id].eqNullSafe(reps["_rep"]), "left_semi").select(F.coalesce(text, F.lit("")).alias("_text"))
    sets = stored(
        shingle_sets(texts, words).join(wanted.select("hi", "lo", "node"), ["hi", "lo"]).select("node", "shingles").dropDuplicates(["node"]),
        "sets",
    )
    sizes = wanted.select("node", "n")
    edges = stored(_linked(pairs, sizes, sets, similarity), "links")
    groups = components(edges)
    # a centre has met its whole star; what is left are links between its other members
    stars = pairs.select(F.col("a").alias("star"), F.col("b").alias("node"))
    more = stored(_within(stars, groups, sizes, sets, similarity, block), "more-links")
    return groups if more.isEmpty() else components(edges.union(more))


def _within(stars: DataFrame, groups: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: int, block: int) -> DataFrame:
    """Links (a, b) between members of a star that are in different components."""
    labelled = stars.join(groups, "node", "left").select("star", "node", F.coalesce("root", "node").alias("root")).join(sizes, "node")
    labelled = stored(labelled, "members")
    parts = labelled.groupBy("star", "root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
    largest = parts.groupBy("star").agg(
        F.max(F.struct("members", "root", "n")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")
    ).where("roots > 1")

    def blocks(n):
        return F.least(F.ceil(n / block), F.greatest(F.lit(BLOCKS), F.ceil(n / LARGE_BLOCK))).cast("int")

    plan = stored(
        largest.select("star", F.col("m.root").alias("main"), blocks(F.col("n") - F.col("m.n")).alias("rows"), blocks(F.col("n")).alias("columns")),
        "open-stars",
    )
    rows = labelled.join(plan, "star")
    at = F.xxhash64("node")
    every = rows.select(
        "star", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(at, F.col("columns")).cast("int").alias("column"),
        F.lit(False).alias("outside"), "node", "root",
    )
    outside = rows.where("root <> main").select(
        "star", F.pmod(at, F.col("rows")).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"),
        F.lit(True).alias("outside"), "node", "root",
    )
    cells = every.union(outside).join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        out = table.column("outside").to_numpy(zero_copy_only=False)
        nodes, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
        lists = table.column("shingles").combine_chunks()
        values, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        left, right = np.flatnonzero(out), np.flatnonzero(~out)
        a, b = linked_blocks(values, offsets, roots, left, right, similarity)
        return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})

    return cells.groupBy("star", "row", "column").applyInArrow(compare, "a long, b long")


def linked_blocks(values, offsets, roots, left, right, similarity, side: int = SIDE):
    """Indices of one pair of similar enough sets for every two roots that have such a pair.

    Tables of pairs are made for `side` sets a side at a time, however many sets there are.
    """
    left, right = (
        some[may_link(values, offsets, roots, some, others, similarity)] for some, others in ((left, right), (right, left))
    )
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(left), side):
        for j in range(0, len(right), side):
            found = _linked_slices(values, offsets, roots, left[i : i + side], right[j : j + side], similarity)
            if len(found[0]):
                a, b = np.concatenate([a, found[0]]), np.concatenate([b, found[1]])
                _, first = np.unique(np.stack([roots[a], roots[b]]), axis=1, return_index=True)
                a, b = a[first], b[first]
    return a, b


def may_link(values, offsets, roots, some, others, similarity) -> np.ndarray:
    """Whether enough shingles of each set of `some` occur in `others` under another root; the rest are linked with none."""
    if not len(some) or not len(others):
        return np.zeros(len(some), bool)
    row, value = entries(values, offsets, some)
    row_o, value_o = entries(values, offsets, others)
    order = np.argsort(value_o, kind="stable")
    value_o, root_o = value_o[order], roots[others[row_o[order]]]
    start = np.flatnonzero(np.r_[True, value_o[1:] != value_o[:-1]])
    words, low, high = value_o[start], np.minimum.reduceat(root_o, start), np.maximum.reduceat(root_o, start)
    at = np.minimum(np.searchsorted(words, value), len(words) - 1)
    own = roots[some[row]]
    met = (words[at] == value) & ((low[at] != own) | (high[at] != own))
    return 100 * np.bincount(row[met], minlength=len(some)) >= similarity * np.diff(offsets)[some]


def _linked_slices(values, offsets, roots, left, right, similarity):
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    la, lb = size[left][:, None], size[right][None, :]
    able = (roots[left][:, None] != roots[right][None, :]) & (100 * np.minimum(la, lb) >= similarity * np.maximum(la, lb))
    keep_l, keep_r = able.any(1), able.any(0)
    if not keep_l.any():
        return none, none
    left, right, able = left[keep_l], right[keep_r], able[keep_l][:, keep_r]
    x = shared_counts(values, offsets, left, right)
    la, lb = size[left][:, None], size[right][None, :]
    i, j = np.nonzero(able & (100 * x >= similarity * (la + lb - x)))
    _, first = np.unique(np.stack([roots[left[i]], roots[right[j]]]), axis=1, return_index=True)
    return left[i[first]], right[j[first]]


def entries(values, offsets, some):
    """The place in `some` and the shingle, for each shingle of these sets."""
    length = offsets[some + 1] - offsets[some]
    row = np.repeat(np.arange(len(some)), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(offsets[some], length)
    return row, values[at]


def shared_counts(values, offsets, left, right, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set.

    Shingles that many sets have are counted by matrix products, the others pair by pair.
    """
    row_l, value_l = entries(values, offsets, left)
    row_r, value_r = entries(values, offsets, right)
    words, column_l = np.unique(value_l, return_inverse=True)
    column_r = np.minimum(np.searchsorted(words, value_r), len(words) - 1)
    met = words[column_r] == value_r
    row_r, column_r = row_r[met], column_r[met]
    n_l, n_r = np.bincount(column_l, minlength=len(words)), np.bincount(column_r, minlength=len(words))
    total = np.zeros((len(left), len(right)), np.int64)
    common = n_l * n_r * 64 > len(left) * len(right)
    chosen = np.flatnonzero(common)
    place = np.full(len(words), -1)
    for at in range(0, len(chosen), width):
        part = chosen[at : at + width]
        place[part] = np.arange(len(part))
        sides = []
        for row, column, n in ((row_l, column_l, len(left)), (row_r, column_r, len(right))):
            here = place[column] >= 0
            side = np.zeros((n, len(part)), np.float32)
            side[row[here], place[column[here]]] = 1
            sides.append(side)
        total += (sides[0] @ sides[1].T).astype(np.int64)
        place[part] = -1
    rare_l, rare_r = ~common[column_l], ~common[column_r]
    row_l, column_l, row_r, column_r = row_l[rare_l], column_l[rare_l], row_r[rare_r], column_r[rare_r]
    order = np.argsort(column_r, kind="stable")
    row_r, column_r = row_r[order], column_r[order]
    start, end = np.searchsorted(column_r, column_l), np.searchsorted(column_r, column_l, "right")
    done = np.concatenate([[0], np.cumsum(end - start)])
    at = 0
    while at < len(row_l):  # about a million meetings at a time
        to = max(at + 1, int(np.searchsorted(done, done[at] + 1_000_000)) - 1)
        s, e, rows = start[at:to], end[at:to], row_l[at:to]
        n, at = e - s, to
        pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
        flat = np.repeat(rows, n) * len(right) + row_r[pick]
        total += np.bincount(flat, minlength=total.size).reshape(total.shape)
    return total


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    similarity: int = SIMILARITY,
    id: str = "doc_id",
    text: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """id, n_shingles, component_id, kept for every row.

    Letters A-Z are lower-cased; words are runs of other characters than
    [\\x20\\x09-\\x0D]. Two documents are linked if their sets of `words`-word shingles
    (64-bit hashes of whole shingles) have at least `similarity` per cent in common;
    component_id is the smallest id reachable over links. Null, empty and blank texts have
    no shingles and are linked with nothing; their component is their own id. Rows with the
    same id and different texts are nodes of their own. A null id is no candidate for
    component_id unless all ids of the component are null. An empty table gives no
    rows; other columns are not read.
    """
    need(docs, id, text)
    signed = stored(signatures(docs, words, bands, rows, id, text), "signatures")
    classes = stored(
        signed.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    member = signed.join(classes.select("hi", "lo", "node", "rep"), ["hi", "lo"], "left")
    buckets = member.where(F.col("id").eqNullSafe(F.col("rep")) & F.col("node").isNotNull()).select(F.explode("bands").alias("key"), "node")
    groups = links(docs, classes, buckets, words, similarity, id, text, block)
    rooted = classes.select("node", "rep").join(groups, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    # stored, so that the join below stands alone in its stage and a large component's rows can be split
    smallest = stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "smallest")
    named = stored(rooted.join(smallest, "root").select("node", "component_id"), "components")
    marked = member.select("id", "n_shingles", "node").join(named, "node", "left").select(
        "id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return marked.select(
        F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
