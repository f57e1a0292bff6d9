"""Phrases whose words belong together, by language.

Every task counts the 1- to 4-word sequences of its texts, sorts them and builds a count
transducer from them: an acyclic automaton whose paths are phrases and whose states carry the
number of occurrences (`Counts`). The transducers are cut at common prefixes, so that one task unites all
that share a range of prefixes and adds up their weights. This is done twice: for words and pairs, then for
longer phrases all of whose pairs are frequent, as no other can be (`Follows`). Counts of the parts of a phrase are found by
composition: a range sends the automaton of the parts it asks for to the ranges that hold them,
and gets it back with their weights.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pharmasift.llm.common import need, stored

WORDS = 4
LEAST = 30
SCALE = 2_000_000
TOP = 2000
#: A candidate goes if a longer one that holds it has at least this percentage of its occurrences.
INSIDE = 80
#: Words that one transducer of a task is built from.
SHARD_WORDS = 1_000_000
#: States of one stored piece of a transducer, about.
BLOCK_STATES = 50_000
#: States (before they are united) of one range of prefixes, about.
RANGE_STATES = 1_000_000
#: Bits for each frequent pair of words, and at most: that filter goes to every task. A pair let through wrongly costs states only.
PAIR_BITS, MAX_BITS = 32, 1 << 26
#: Paths from which the borders of ranges are chosen, which decide about sizes only.
BORDER_SAMPLE = 200_000
#: Such paths of a stored piece of full size, about.
BLOCK_MARKS = 10
#: Parts of a language that are ranked by themselves before its best phrases are.
RANKED_PARTS = 32

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)

#: The end of a piece among words, where no full stop is left.
_END = b"."

Key = tuple[bytes, ...]


class Counts:
    """A count transducer over words; states by number of words, each level in the order of its paths.

    Of a state: `parents` (its place in the level before), `words` (place in the sorted `vocabulary`) and
    `weights` (occurrences; 0 where the path only leads to others).
    """

    def __init__(self, vocabulary: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.vocabulary = vocabulary
        self.levels = levels

    @property
    def states(self) -> int:
        return sum(len(words) for _, words, _ in self.levels)

    def keys(self, level: int) -> np.ndarray:
        return self._keys[level]

    @cached_property
    def _keys(self) -> list[np.ndarray]:
        return [parents * max(1, len(self.vocabulary)) + words for parents, words, _ in self.levels]

    @classmethod
    def from_sorted(cls, phrases: Iterable[Key], weights: Iterable[int], longest: int = WORDS) -> Counts:
        """Built one phrase after the other; each adds the states that the one before doesn't share with it."""
        phrases = list(phrases)
        vocabulary = sorted({w for p in phrases for w in p})
        place = {w: i for i, w in enumerate(vocabulary)}
        levels: list[tuple[list, list, list]] = [([], [], []) for _ in range(longest)]
        before: Key = ()
        for phrase, weight in zip(phrases, weights):
            same = 0
            while same < min(len(before), len(phrase)) and before[same] == phrase[same]:
                same += 1
            for m in range(same, len(phrase)):
                parents, words, sums = levels[m]
                parents.append(len(levels[m - 1][1]) - 1 if m else 0)
                words.append(place[phrase[m]])
                sums.append(0)
            levels[len(phrase) - 1][2][-1] += weight
            before = phrase
        return cls(vocabulary, [tuple(np.array(x, np.int64) for x in level) for level in levels])

    @classmethod
    def of_text(cls, ids: np.ndarray, vocabulary: list[bytes], starts: int, longest: int = WORDS, follows: np.ndarray | None = None) -> Counts:
        """Of a sequence of 1-based word numbers, 0 at ends of pieces; phrases begin at the first `starts` places.

        With `follows`, whether the pair that begins at a place may count, only phrases of such pairs, of three words or more.
        """
        order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
        rank = np.full(len(vocabulary) + 1, -1, np.int64)
        rank[np.array(order, np.int64) + 1] = np.arange(len(order))
        at = rank[ids]
        n = len(at)
        end = np.minimum.accumulate(np.where(at < 0, np.arange(n), n)[::-1])[::-1] if n else at
        place = np.flatnonzero(at[:starts] >= 0)
        if follows is not None:
            place = place[place + 2 < end[place]]
            place = place[follows[place] & follows[place + 1]]
        state = np.zeros(len(place), np.int64)
        levels = []
        for m in range(longest):
            longer = place + m < end[place]
            if follows is not None and m > 2:
                longer &= follows[place + m - 1]
            place, state = place[longer], state[longer]
            key, state, weight = np.unique(state * max(1, len(order)) + at[place + m], return_inverse=True, return_counts=True)
            weight = weight.astype(np.int64) if follows is None or m > 1 else np.zeros(len(key), np.int64)
            levels.append((key // max(1, len(order)), key % max(1, len(order)), weight))
        return cls([vocabulary[i] for i in order], levels)

    def border(self, key: Key) -> list[int]:
        """For each level, how many paths come before `key`."""
        out: list[int] = []
        on_path, left = True, 0
        for m in range(len(self.levels)):
            parents = self.levels[m][0]
            on_path = on_path and m < len(key)
            if not on_path:
                left = int(np.searchsorted(parents, left)) if m else 0
                out.append(left)
                continue
            word = bisect_left(self.vocabulary, key[m])
            known = word < len(self.vocabulary) and self.vocabulary[word] == key[m]
            wanted = left * max(1, len(self.vocabulary)) + word
            keys = self.keys(m)
            left = int(np.searchsorted(keys, wanted))
            on_path = known and left < len(keys) and int(keys[left]) == wanted
            out.append(left + (on_path and len(key) > m + 1))
        return out

    def part(self, low: list[int], high: list[int]) -> Counts:
        """The paths between two borders; states that only lead there have weight 0."""
        low = [min(a, b) for a, b in zip(low, high)]
        first = list(low)
        for m in range(len(self.levels) - 1, 0, -1):
            if first[m] < high[m]:
                first[m - 1] = min(first[m - 1], int(self.levels[m][0][first[m]]))
        levels = []
        for m, (parents, words, weights) in enumerate(self.levels):
            a, b = first[m], max(first[m], high[m])
            w = weights[a:b].copy()
            w[: low[m] - a] = 0
            levels.append((parents[a:b] - (first[m - 1] if m else 0), words[a:b], w))
        return Counts(self.vocabulary, levels).tight()

    def tight(self) -> Counts:
        """With the words in use only."""
        used = np.unique(np.concatenate([words for _, words, _ in self.levels]))
        return Counts([self.vocabulary[i] for i in used], [(p, np.searchsorted(used, words), w) for p, words, w in self.levels])

    def deeper(self, longest: int) -> Counts:
        """With empty levels up to `longest` words."""
        none = np.zeros(0, np.int64)
        return Counts(self.vocabulary, self.levels + [(none, none, none)] * (longest - len(self.levels)))

    def path(self, level: int, state: int) -> Key:
        found: list[bytes] = []
        for m in range(level, -1, -1):
            parents, words, _ = self.levels[m]
            found.append(self.vocabulary[words[state]])
            state = int(parents[state])
        return tuple(reversed(found))

    def first(self) -> Key:
        """The first path that has a weight."""
        heads = [(m, int(np.argmax(w > 0))) for m, (_, _, w) in enumerate(self.levels) if (w > 0).any()]
        return min(self.path(m, i) for m, i in heads)

    def last(self) -> Key:
        tails = [(m, len(w) - 1 - int(np.argmax(w[::-1] > 0))) for m, (_, _, w) in enumerate(self.levels) if (w > 0).any()]
        return max(self.path(m, i) for m, i in tails)

    def blocks(self, states: int) -> Iterator[Counts]:
        """In pieces of about `states` states a level."""
        marks = sorted({self.path(m, i) for m, (_, words, _) in enumerate(self.levels) for i in range(states, len(words), states)})
        for piece in self.cut(marks):
            if any((w > 0).any() for _, _, w in piece.levels):
                yield piece

    def marks(self, step: int) -> list[Key]:
        """About one path for each `step` states, at places that the content decides, so that like transducers give unlike ones."""
        at, out = crc32(b"".join(w.tobytes() for _, _, w in self.levels)) % step, []
        for m, (_, words, _) in enumerate(self.levels):
            out += [self.path(m, i) for i in range(at, len(words), step)]
            at = (at - len(words)) % step if at < len(words) else at - len(words)
        return out

    def cut(self, marks: list[Key]) -> Iterator[Counts]:
        """The parts before, between and after sorted keys."""
        low = [0] * len(self.levels)
        for mark in marks:
            high = self.border(mark)
            yield self.part(low, high)
            low = high
        yield self.part(low, [len(words) for _, words, _ in self.levels])

    def phrases(self, level: int) -> list[bytes]:
        """All paths of a level, words joined by spaces."""
        out = [self.vocabulary[i] for i in self.levels[0][1]]
        for parents, words, _ in self.levels[1 : level + 1]:
            out = [out[p] + b" " + self.vocabulary[w] for p, w in zip(parents.tolist(), words.tolist())]
        return out

    def frequent(self, least: int) -> Counts:
        """Paths with at least `least` occurrences, and what leads to them."""
        keep = [w >= least for _, _, w in self.levels]
        for m in range(len(self.levels) - 1, 0, -1):
            keep[m - 1][self.levels[m][0][keep[m]]] = True
        levels, new = [], np.zeros(1, np.int64)
        for (parents, words, weights), kept in zip(self.levels, keep):
            w = weights[kept]
            levels.append((new[parents[kept]] if len(levels) else parents[kept], words[kept], np.where(w >= least, w, 0)))
            new = np.cumsum(kept) - 1
        return Counts(self.vocabulary, levels).tight()

    @staticmethod
    def union(all: list[Counts]) -> Counts:
        """All paths, with the sums of their weights."""
        if len(all) == 1:
            return all[0]
        vocabulary = sorted(set().union(*(c.vocabulary for c in all)))
        place = {w: i for i, w in enumerate(vocabulary)}
        renamed = [np.array([place[w] for w in c.vocabulary], np.int64) for c in all]
        states = [np.zeros(1, np.int64) for _ in all]
        levels = []
        for m in range(max(len(c.levels) for c in all)):
            keys = [s[c.levels[m][0]] * max(1, len(vocabulary)) + r[c.levels[m][1]] for c, r, s in zip(all, renamed, states)]
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            weights = np.zeros(len(key), np.int64)
            np.add.at(weights, at, np.concatenate([c.levels[m][2] for c in all]))
            levels.append((key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), weights))
            states = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        return Counts(vocabulary, levels)

    def compose(self, counts: Counts) -> Counts:
        """This automaton's paths with the weights that `counts` has for them."""
        place = {w: i for i, w in enumerate(counts.vocabulary)}
        word_of = np.array([place.get(w, -1) for w in self.vocabulary], np.int64)
        state, levels = np.zeros(1, np.int64), []
        for m, (parents, words, asked) in enumerate(self.levels):
            keys = counts.keys(m)
            above, word = state[parents], word_of[words]
            wanted = above * max(1, len(counts.vocabulary)) + word
            at = np.searchsorted(keys, wanted)
            found = (above >= 0) & (word >= 0) & (at < len(keys))
            found[found] = keys[at[found]] == wanted[found]
            state = np.where(found, at, -1)
            weights = np.zeros(len(words), np.int64)
            weights[found] = counts.levels[m][2][at[found]]
            levels.append((parents, words, np.where(asked > 0, weights, 0)))
        return Counts(self.vocabulary, levels)

    def to_bytes(self) -> bytes:
        """Sizes, words, then for each level arcs per state, words and weights, compressed."""
        names = b" ".join(self.vocabulary)
        sizes = [len(words) for _, words, _ in self.levels]
        parts = [np.array([len(names), len(sizes), *sizes], np.int64).tobytes(), names]
        for m, (parents, words, weights) in enumerate(self.levels):
            arcs = np.bincount(parents, minlength=sizes[m - 1] if m else 1)
            parts += [arcs.astype(np.int32).tobytes(), words.astype(np.int32).tobytes(), weights.tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def from_bytes(cls, data: bytes) -> Counts:
        data = zstandard.ZstdDecompressor().decompress(data)
        length, depth = np.frombuffer(data, np.int64, 2)
        sizes = np.frombuffer(data, np.int64, depth, 16).tolist()
        at = 16 + 8 * int(depth)
        names = data[at : at + int(length)]
        at += int(length)
        levels, above = [], 1
        for n in sizes:
            arcs = np.frombuffer(data, np.int32, above, at)
            words = np.frombuffer(data, np.int32, n, at + 4 * above)
            weights = np.frombuffer(data, np.int64, n, at + 4 * above + 4 * n)
            levels.append((np.repeat(np.arange(above), arcs), words.astype(np.int64), weights))
            at += 4 * above + 12 * n
            above = n
        return cls(names.split(b" ") if names else [], levels)


class Follows:
    """Pairs of words of a language that may be frequent: a bit for each hash, so that all frequent ones are known."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(blake2b(w, digest_size=8).digest() for w in words), np.uint64)

    @classmethod
    def places(cls, lang: str, first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
        """Bits of pairs of hashed words; `size` is a power of two."""
        x = first * np.uint64(0x9E3779B97F4A7C15) + second + cls.hashes([lang.encode()])
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) & np.uint64(size - 1)).astype(np.int64)

    @classmethod
    def of(cls, counts: DataFrame) -> Follows:
        """Of the stored frequent paths; bits are united before they are collected, MAX_BITS at most."""
        n = counts.agg(F.sum("pairs")).first()[0] or 0
        size = min(MAX_BITS, max(1 << 10, 1 << int(PAIR_BITS * n).bit_length()))

        def places(batches):
            for batch in batches:
                for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    c = Counts.from_bytes(data.as_py())
                    hashed = cls.hashes(c.vocabulary)
                    parents, words, weights = (x[c.levels[1][2] > 0] for x in c.levels[1])
                    yield _rows(["bit"], [np.unique(cls.places(lang, hashed[c.levels[0][1][parents]], hashed[words], size))], [pa.int64()])

        bit = counts.where("pairs > 0").select("lang", "counts").mapInArrow(places, "bit long")
        place, inside = F.expr("bit div 32").alias("place"), F.expr("shiftleft(1L, CAST(bit % 32 AS INT))")
        found = bit.groupBy(place).agg(F.bit_or(inside).alias("bits")).toArrow()
        bits = np.zeros(size // 32, np.uint32)
        bits[found["place"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
        return cls(bits)

    def of_places(self, lang: str, ids: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
        """For each place of a sequence of word numbers, whether the pair that begins there may be frequent."""
        hashed = np.concatenate([np.zeros(1, np.uint64), self.hashes(vocabulary)])[ids]
        bit = self.places(lang, hashed[:-1], hashed[1:], 32 * len(self.bits))
        known = (self.bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1)
        return np.append(known.astype(bool) & (ids[:-1] > 0) & (ids[1:] > 0), False)


class _Vocabulary(dict):
    """Words numbered from 1 as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shards:
    """Texts to count transducers of at most about `limit` words, by language."""

    def __init__(self, limit: int = SHARD_WORDS, longest: int = WORDS, follows: Follows | None = None):
        self.limit, self.longest, self.follows = limit, longest, follows
        self.held: dict[str, tuple[_Vocabulary, list[int]]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> Iterator[tuple[str, Counts]]:
        """Takes a text in; gives what had to be counted to keep memory bounded, even within the text."""
        words = text.translate(_LOWER).replace(b"\n", b" . ").split()
        words.append(_END)
        for at in range(0, len(words), self.limit):
            vocabulary, ids = self.held.setdefault(lang, (_Vocabulary(), []))
            some = words[at : at + self.limit]
            ids.extend(map(vocabulary.__getitem__, some))
            self.size += len(some)
            if self.size >= self.limit:
                yield from self.flush(lang if some[-1] != _END else None)

    def flush(self, inside: str | None = None) -> Iterator[tuple[str, Counts]]:
        """Counts what is held; of a language whose piece goes on, its last words begin no phrase yet."""
        held, self.held, self.size = self.held, {}, 0
        for lang, (vocabulary, ids) in held.items():
            words = list(vocabulary)[1:]
            kept = ids[-(self.longest - 1) :] if lang == inside and self.longest > 1 else []
            if 0 in kept:
                kept = kept[len(kept) - kept[::-1].index(0) :]
            numbers = np.array(ids, np.int64)
            follows = self.follows and self.follows.of_places(lang, numbers, words)
            yield lang, Counts.of_text(numbers, words, len(ids) - len(kept), self.longest, follows)
            if kept:
                again = _Vocabulary()
                self.held[lang] = (again, [again[words[i - 1]] for i in kept])
                self.size += len(kept)


_SHARDS = "lang string, first binary, last binary, states long, counts binary, marks array<binary>"
_SHARDS_NAMES = ["lang", "first", "last", "states", "counts", "marks"]
_SHARDS_KINDS = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.binary()))


def _shard(lang: str, c: Counts, step: int) -> list[list]:
    marks = [b" ".join(x) for x in c.marks(step)]
    return [[lang], [b" ".join(c.first())], [b" ".join(c.last())], [c.states], [c.to_bytes()], [marks]]


def _step(block: int) -> int:
    return max(1, block // BLOCK_MARKS)


def shard_counts(
    docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = WORDS, shard_words: int = SHARD_WORDS, block: int = BLOCK_STATES,
    follows: Follows | None = None,
) -> DataFrame:
    """lang, first, last (paths), states, counts and marks (paths at even steps) of the pieces of each task's transducers."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(follows)

    def build(batches):
        shards = Shards(shard_words, longest, shared.value)

        def out(found):
            for name, whole in found:
                for c in whole.blocks(block):
                    yield _rows(_SHARDS_NAMES, _shard(name, c, _step(block)), _SHARDS_KINDS)

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                yield from out(shards.add(name, t.as_py()))
        yield from out(shards.flush())

    return rows.mapInArrow(build, _SHARDS)


class Ranges:
    """Ranges of (lang, path), numbered in order."""

    def __init__(self, borders: list[tuple[bytes, Key]]):
        self.borders = borders

    @classmethod
    def choose(cls, shards: DataFrame, range_states: int) -> Ranges:
        """Borders at even steps of the marks of stored pieces, of BORDER_SAMPLE marks at most.

        First paths of pieces would not do: those of all pieces are about the same, so that more input gave larger ranges, not more.
        """
        states = shards.agg(F.sum("states")).first()[0] or 0
        n = max(1, -(-states // range_states))
        marks = shards.select("lang", F.explode("marks").alias("mark"), F.xxhash64("last", "states", "mark").alias("order"))
        sample = marks.orderBy("order").limit(BORDER_SAMPLE).collect()
        keys = sorted((r["lang"].encode(), tuple(bytes(r["mark"]).split(b" "))) for r in sample)
        n = min(n, len(keys)) or 1
        return cls(sorted({keys[len(keys) * i // n] for i in range(1, n)}))

    def __len__(self) -> int:
        return len(self.borders) + 1

    def number(self, lang: str, key: Key) -> int:
        return bisect_right(self.borders, (lang.encode(), key))

    def deal(self, lang: str, counts: Counts, first: Key, last: Key) -> Iterator[tuple[int, Counts]]:
        """(number, part) for each range that a transducer's paths from `first` to `last` touch."""
        a, b = self.number(lang, first), self.number(lang, last)
        marks = [key for name, key in self.borders[a:b] if name == lang.encode()]
        if not marks:
            yield a, counts
            return
        for i, part in enumerate(counts.cut(marks), a):
            if any((w > 0).any() for _, _, w in part.levels):
                yield i, part


def _rows(schema_names: list[str], values: list[list], kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds)], names=schema_names)


_DEALT = "range long, lang string, kind int, source long, counts binary"
_DEALT_NAMES = ["range", "lang", "kind", "source", "counts"]
_DEALT_KINDS = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())


def _dealt(ranges: Ranges, found: Iterable[tuple[str, Counts, Key, Key]], kind: int, source: int) -> Iterator[pa.RecordBatch]:
    for lang, counts, first, last in found:
        for number, part in ranges.deal(lang, counts, first, last):
            yield _rows(_DEALT_NAMES, [[number], [lang], [kind], [source], [part.to_bytes()]], _DEALT_KINDS)


def _together(rows: DataFrame, ranges: int) -> DataFrame:
    """All rows of a range in one task, one range after the other, counts before requests."""
    return rows.repartition(ranges, "range").sortWithinPartitions("range", "lang", "kind", "source")


def _groups(batches) -> Iterator[tuple[tuple[int, str], Iterator[tuple[int, int, Counts]]]]:
    """((range, lang), its (kind, source, counts) one at a time) of sorted rows."""
    from itertools import groupby

    def one_by_one():
        for batch in batches:
            for i in range(batch.num_rows):
                r = [c[i].as_py() for c in batch.columns]
                yield (r[0], r[1]), (r[2], r[3], Counts.from_bytes(r[4]))

    for key, group in groupby(one_by_one(), key=lambda x: x[0]):
        yield key, (x for _, x in group)


def _merged(parts: Iterable[Counts], factor: int = 2) -> Counts:
    """The union, with held states bounded by about twice those of the result."""
    held, size, done = [], 0, 0
    for c in parts:
        held.append(c)
        size += c.states
        if size > factor * max(done, 100_000):
            held = [Counts.union(held)]
            size = done = held[0].states
    return Counts.union(held)


def range_counts(shards: DataFrame, ranges: Ranges, least: int, longest: int = WORDS, block: int = BLOCK_STATES) -> DataFrame:
    """The frequent paths of every range, with all occurrences in all shards, up to `longest` words.

    As shards, with their range, the number of words in all and of frequent pairs.
    """

    def deal(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, first, last, counts = (c[i].as_py() for c in batch.columns)
                yield from _dealt(ranges, [(lang, Counts.from_bytes(counts), tuple(first.split(b" ")), tuple(last.split(b" ")))], 0, 0)

    def unite(batches):
        for (number, lang), group in _groups(batches):
            whole = _merged(c for _, _, c in group)
            words = int(whole.levels[0][2].sum())
            few = whole.frequent(least).deeper(longest)
            pairs = int((few.levels[1][2] > 0).sum()) if longest > 1 else 0
            shard = _shard(lang, few, _step(block)) if few.states else [[lang], [b""], [b""], [0], [few.to_bytes()], [[]]]
            yield _rows([*_SHARDS_NAMES, "range", "n", "pairs"], [*shard, [number], [words], [pairs]], (*_SHARDS_KINDS, *[pa.int64()] * 3))

    return _together(shards.select("lang", "first", "last", "counts").mapInArrow(deal, _DEALT), len(ranges)).mapInArrow(unite, f"{_SHARDS}, range long, n long, pairs long")


def _candidates(counts: Counts) -> Iterator[tuple[Key, int]]:
    for m in range(1, len(counts.levels)):
        for phrase, a in zip(counts.phrases(m), counts.levels[m][2].tolist()):
            if a > 0:
                yield tuple(phrase.split(b" ")), a


def worst_cut(phrase: Key, a: int, weight: dict[bytes, int], scale: int = SCALE) -> tuple[int, int, int, int]:
    """(score, k, l, r) of the cut after k words with the lowest score, in whole numbers of any size."""
    cuts = []
    for k in range(1, len(phrase)):
        left, right = weight[b" ".join(phrase[:k])], weight[b" ".join(phrase[k:])]
        cuts.append((scale * a // (left + right), k, left, right))
    return min(cuts)


def scored(counts: DataFrame, ranges: Ranges, scale: int = SCALE) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every candidate in the stored frequent paths of ranges."""

    def ask(batches):
        for (number, lang), group in _groups(batches):
            parts = set()
            for _, _, c in group:
                for phrase, _ in _candidates(c):
                    for k in range(1, len(phrase)):
                        parts.add(phrase[:k])
                        parts.add(phrase[k:])
            if parts:
                wanted = sorted(parts)
                automaton = Counts.from_sorted(wanted, [1] * len(wanted))
                yield from _dealt(ranges, [(lang, automaton, wanted[0], wanted[-1])], 1, number)

    def answer(batches):
        for (_, lang), group in _groups(batches):
            have = None
            for kind, source, c in group:
                if kind == 0:
                    have = c
                else:
                    yield _rows(_DEALT_NAMES, [[source], [lang], [1], [source], [c.compose(have).to_bytes()]], _DEALT_KINDS)

    def score(batches):
        for (_, lang), group in _groups(batches):
            own, weight = None, {}
            for kind, _, c in group:
                if kind == 0:
                    own = c
                else:
                    for m in range(len(c.levels)):
                        weight.update((p, n) for p, n in zip(c.phrases(m), c.levels[m][2].tolist()) if n)
            rows = []
            for phrase, a in _candidates(own):
                best, _, left, right = worst_cut(phrase, a, weight, scale)
                rows.append((lang, b" ".join(phrase).decode(), len(phrase), a, left, right, best))
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4)
                yield _rows(["lang", "phrase", "words", "a", "l", "r", "score"], [list(x) for x in zip(*rows)], kinds)

    plain = counts.select("range", "lang", F.lit(0).alias("kind"), F.col("range").alias("source"), "counts")
    asked = plain.mapInArrow(ask, _DEALT)
    answered = stored(_together(plain.union(asked), len(ranges)).mapInArrow(answer, _DEALT), "answers")
    return _together(plain.union(answered), len(ranges)).mapInArrow(
        score, "lang string, phrase string, words int, a long, l long, r long, score long"
    )


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, inside: int = INSIDE,
    longest: int = WORDS, shard_words: int = SHARD_WORDS, range_states: int = RANGE_STATES, block: int = BLOCK_STATES,
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased in A-Z and end at blanks; phrases of 2 to `longest` words don't cross . , ; : ! ? or line
    ends. A phrase with a >= `least` occurrences scores floor(2000000 a / (l + r)) at its worst cut into parts with l and r
    occurrences; it goes if a longer candidate around it has `inside` percent of its occurrences. n counts the language's words.
    Null languages are `und`, null texts empty; an empty table gives no rows; other columns are not read.
    """
    need(docs, lang, text)
    shards = stored(shard_counts(docs, lang, text, min(longest, 2), shard_words, block), "shards")
    ranges = Ranges.choose(shards, range_states)
    totals = counts = stored(range_counts(shards, ranges, least, longest, block), "counts")
    if longest > 2:
        longer = stored(shard_counts(docs, lang, text, longest, shard_words, block, Follows.of(counts)), "shards")
        shards = counts.where("states > 0").select(*_SHARDS_NAMES).unionByName(longer)
        ranges = Ranges.choose(shards, range_states)
        counts = stored(range_counts(shards, ranges, least, longest, block), "counts")
    found = stored(scored(counts, ranges), "candidates")
    words = F.split("phrase", " ")
    shorter = [(i, m) for size in range(3, longest + 1) for m in range(2, size) for i in range(1, size - m + 2)]
    parts = F.filter(
        F.array(*(F.when(F.col("words") >= i + m - 1, F.when(F.col("words") > m, F.array_join(F.slice(words, i, m), " "))) for i, m in sorted(set(shorter)))),
        lambda x: x.isNotNull(),
    )
    longer = found.where("words > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = found.join(longer, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * inside)
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of a language are among the best of its parts, which many tasks rank
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS))
    parted = Window.partitionBy("lang", part).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(parted)).where(F.col("rank") <= top).drop("rank")
    whole = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    best = few.select("lang", "phrase", "a", "l", "r", "score", whole.alias("rank")).where(F.col("rank") <= top)
    totals = totals.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
