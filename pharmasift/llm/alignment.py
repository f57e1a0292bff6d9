"""Alignment of two tokenizers' tokens by the bytes they cover.

Byte offsets at which tokens of both vocabularies end cut a text into groups. Most groups
are one token against one token of the same bytes: an identity map (id of A to the id of B
with the same bytes) describes them, and a vector over the vocabulary of A counts them.
Only the other groups are counted as pairs of ids in a shuffle.

Texts are cut where both vocabularies always end a token (before a blank after a
visible character, or between a letter and a symbol), and each distinct piece is aligned once per task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.llm.common import need, stored
from pharmasift.llm.encode import byte_letters

#: Bytes of text whose new pieces are encoded together.
GROUP_BYTES = 512 * 1024
#: Estimated bytes of remembered pieces; the memory is emptied beyond it, which changes no result.
MEMORY_BYTES = 160 * 1024 * 1024
#: Longer pieces are aligned anew each time.
LONG_PIECE = 64
#: A pair that holds at least this part of all irregular links is frequent, so at most this many are.
FREQUENT_PART = 100_000

_LETTER = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: Where both vocabularies end a token: visible ASCII or Latin-1 before a blank or line feed, and a letter before an ASCII
#: symbol other than the apostrophe (no token of B has a letter before a symbol, or a line feed).
_SAFE = re.compile(
    rb"(?=[ \n])(?:(?<=[!-~])|(?<=\xc3[\x80-\xbf]))|(?=[!-&(-/:-@\[-`{-~])(?:(?<=[A-Za-z])|(?<=" + _LETTER + rb"))"
)
_PLAIN = re.compile(rb" (?:[A-Za-z]|" + _LETTER + rb")+")

LINKS = (
    "n_a long, n_b long, n_groups long, groups_sha256 string, "
    "same array<int>, same_n array<int>, pair array<long>, pair_n array<int>"
)


def slices(text: bytes, limit: int = GROUP_BYTES) -> Iterator[bytes]:
    """The text in slices of about `limit` bytes, cut only at safe places."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Vocabularies:
    """A byte-level vocabulary (A) and a sentencepiece model (B): ids of a piece and bytes of an id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.space, self.line = self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")
        plain = (i for i in range(self.b.get_piece_size()) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        if any(re.search(r"\n|[^▁]▁|[A-Za-zÀ-ÖØ-öø-ÿ][!-&(-/:-@\[-`{-~]", self.b.id_to_piece(i)) for i in plain):
            raise ValueError("the second vocabulary has tokens across places where texts are cut")
        self.letters = byte_letters()
        self.model = self.a.model
        bytes_of = {letter: bytes([b]) for b, letter in byte_letters().items()}
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = b"".join(bytes_of.get(c) or c.encode() for c in token)
        self.bytes_b: list[bytes] = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())

    def identity(self) -> np.ndarray:
        """For each id of A the id of B with the same bytes (the largest, which is a piece, not a byte), or -1."""
        ids = {x: i for i, x in enumerate(self.bytes_b) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        return np.array([ids.get(x, -1) for x in self.bytes_a], np.int64)

    def ids_a(self, pieces: list[bytes]) -> list[list[int]]:
        """Words straight from the merge model, all others through the whole tokenizer."""
        found: list = [None] * len(pieces)
        tokenize, letters, other = self.model.tokenize, self.letters, []
        for n, piece in enumerate(pieces):
            if _PLAIN.fullmatch(piece):
                word = "Ġ" + piece[1:].decode() if piece.isascii() else "".join(map(letters.__getitem__, piece))
                found[n] = [t.id for t in tokenize(word)]
            else:
                other.append(n)
        done = self.a.encode_batch_fast([pieces[n].decode() for n in other], add_special_tokens=False)
        for n, e in zip(other, done):
            found[n] = e.ids
        return found

    def ids_b(self, pieces: list[bytes]) -> list[list[int]]:
        """B puts a blank before each text: that of the piece, or one that a line feed keeps apart from the piece."""
        texts = [p[1:].decode() if p[:1] == b" " else "\n" + p.decode() for p in pieces]
        found = []
        for piece, text, ids in zip(pieces, texts, self.b.encode(texts, num_threads=1)):
            if piece[:1] != b" ":
                if ids[:2] != [self.space, self.line]:
                    raise ValueError("the second vocabulary joins line feeds to other characters")
                ids = ids[2:]
            found.append(ids if text else [self.space])
        return found


class Aligner:
    """Aligned pieces: (n_a, n_b, n_groups, groups as text, identity ids, pair codes), None where bytes differ."""

    def __init__(self, path_a: str, path_b: str):
        self.words = Vocabularies(path_a, path_b)
        self.size_a = [len(x) for x in self.words.bytes_a]
        self.size_b = [len(x) for x in self.words.bytes_b]
        self.name_a = [str(i) for i in range(len(self.size_a))]
        self.name_b = [str(i) for i in range(len(self.size_b))]
        self.same = self.words.identity().tolist()
        self.known: dict[bytes, tuple | None] = {}
        self.older: dict[bytes, tuple | None] = {}
        self.held = 0

    def align(self, piece: bytes, a: list[int], b: list[int]) -> tuple | None:
        """Groups of ids between common ends, in order."""
        words, size_a, size_b, name_a, name_b = self.words, self.size_a, self.size_b, self.name_a, self.name_b
        if b"".join([words.bytes_a[i] for i in a]) != piece or b"".join([words.bytes_b[i] for i in b]) != piece:
            return None
        shown, same, pairs = [], [], []
        i = j = first_a = first_b = 0
        last_a, last_b = len(a) - 1, len(b) - 1
        end_a, end_b = size_a[a[0]], size_b[b[0]]
        while True:
            if end_a < end_b:
                i += 1
                end_a += size_a[a[i]]
            elif end_b < end_a:
                j += 1
                end_b += size_b[b[j]]
            else:
                x, y = a[i], b[j]
                if i == first_a and j == first_b:
                    shown.append(f"{name_a[x]}|{name_b[y]}")
                    regular = self.same[x] == y
                else:
                    shown.append(f"{','.join([name_a[t] for t in a[first_a : i + 1]])}|{','.join([name_b[t] for t in b[first_b : j + 1]])}")
                    regular = False
                if regular:
                    same.append(x)
                else:
                    pairs.append(x << 32 | y)
                if i == last_a and j == last_b:
                    return last_a + 1, last_b + 1, len(shown), ";".join(shown), same, pairs
                i += 1
                j += 1
                first_a, first_b = i, j
                end_a += size_a[a[i]]
                end_b += size_b[b[j]]

    def learn(self, pieces: list[bytes]) -> None:
        """Align pieces not known; what was known of them before the last forgetting is taken over."""
        older, known = self.older, self.known
        new = []
        for p in pieces:
            if p in older:
                known[p] = older[p]
            else:
                new.append(p)
        for p, a, b in zip(new, self.words.ids_a(new), self.words.ids_b(new)):
            known[p] = self.align(p, a, b)

    def document(self, text: bytes) -> tuple | None:
        """n_a, n_b, n_groups, digest, identity ids and pair codes with their counts; None without tokens."""
        n_a = n_b = n_groups = 0
        digest, sep = hashlib.sha256(), ""
        same: Counter = Counter()
        pairs: Counter = Counter()
        for part in slices(b" " + text):
            pieces = _SAFE.split(part)
            if self.held > MEMORY_BYTES // 2:  # what was not used lately is forgotten
                self.older, self.known, self.held = self.known, {}, 0
            known = self.known
            new = list(set(pieces).difference(known))
            self.learn(new)
            aligned = list(map(known.__getitem__, pieces))
            whole = None not in aligned
            if whole:
                count_a, count_b, count_groups, shown, links, others = zip(*aligned)
                digest.update((sep + ";".join(shown)).encode())
                sep = ";"
                n_a += sum(count_a)
                n_b += sum(count_b)
                n_groups += sum(count_groups)
                same.update(chain.from_iterable(links))
                pairs.update(chain.from_iterable(others))
            for p in new:
                if len(p) > LONG_PIECE:
                    del known[p]
                else:
                    self.held += 400 + 12 * len(p)
            if not whole:
                return None
        return n_a, n_b, n_groups, digest.hexdigest(), same, pairs


def link_table(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id, a unique number `row`, the numbers of LINKS, the digest of the groups, and its links as counted ids.

    `same` are ids of A in groups of one token against the B token of the identity map; `pair`
    are A << 32 | B of the last tokens of all other groups.
    """
    need(docs, id, text)
    rows = docs.select(F.col(id).alias("_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "row", *(part.split()[0] for part in LINKS.split(", "))]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *(pa.list_(k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.int32())))

    def align(batches):
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for t in batch.column(2).cast(pa.binary()):
                value = t.as_py()
                found = aligner.document(value) if value else None
                n_a, n_b, n_groups, sha, same, pairs = found or (0, 0, 0, "", {}, {})
                values = (n_a, n_b, n_groups, sha, list(same), list(same.values()), list(pairs), list(pairs.values()))
                for column, x in zip(out, values):
                    column.append(x)
            arrays = [pa.array(x, k) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=names)

    return rows.mapInArrow(align, f"_id {id_type}, row long, {LINKS}").withColumnRenamed("_id", id)


def _flat(batch: pa.RecordBatch, values: str, counts: str) -> tuple[np.ndarray, np.ndarray]:
    at = batch.schema.get_field_index
    return (
        batch.column(at(values)).flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        batch.column(at(counts)).flatten().to_numpy(zero_copy_only=False).astype(np.int64),
    )


def identity_counts(links: DataFrame, size: int) -> DataFrame:
    """id, n: how many identity groups each id of A has, added up in one vector of `size` per task."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, n = _flat(batch, "same", "same_n")
            np.add.at(total, ids, n)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return links.select("same", "same_n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pair_counts(links: DataFrame, held: int = 1_000_000) -> DataFrame:
    """pair, n over all irregular links; each task adds up to `held` pairs before it passes them on."""

    def merged(parts):
        codes, n = (np.concatenate(x) for x in zip(*parts))
        codes, at = np.unique(codes, return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, at, n)
        return codes, total

    def count(batches):
        parts, size = [], 0
        for batch in batches:
            parts.append(_flat(batch, "pair", "pair_n"))
            size += len(parts[-1][0])
            if size > held:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > held // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["pair", "n"])
                    parts, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names=["pair", "n"])

    return links.select("pair", "pair_n").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text", frequent_part: int = FREQUENT_PART) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is the last A and the last B token of a group; an id pair's count is its number of links
    in all documents. n_best are links whose count is the highest of their B id, ties included;
    count_sum adds the counts of a document's links. Texts that are null, empty or not restored
    byte by byte by both vocabularies have zeros and an empty digest. Rows that share an id (or have none) are
    documents of their own; an empty table gives no rows; other columns are not read.

    The driver and the tasks get one number per id of either vocabulary and the pairs that hold at
    least 1/`frequent_part` of all irregular links (so at most `frequent_part`); links of rarer pairs
    meet their counts in a shuffle, in which no key is frequent.
    """
    spark = docs.sparkSession
    rows = stored(link_table(docs, path_a, path_b, id, text), "links")
    same = Vocabularies(path_a, path_b).identity()
    regular = identity_counts(rows, len(same)).collect()  # one row per id of A at most
    counts = np.zeros(len(same), np.int64)
    counts[[r["id"] for r in regular]] = [r["n"] for r in regular]
    pairs = stored(pair_counts(rows), "pairs")

    best_of: dict[int, int] = {}
    for i in np.flatnonzero(counts):
        best_of[int(same[i])] = max(best_of.get(int(same[i]), 0), int(counts[i]))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    for r in pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("n")).collect():  # one row per id of B at most
        best_of[r["b"]] = max(best_of.get(r["b"], 0), r["n"])
    best_b = np.zeros(max(best_of, default=0) + 1, np.int64)
    best_b[list(best_of)] = list(best_of.values())

    total = pairs.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * frequent_part >= total
    top = sorted((r["pair"], r["n"]) for r in pairs.where(frequent).collect())
    top_code = np.array([p for p, _ in top], np.int64)
    top_n = np.array([n for _, n in top], np.int64)
    shared = spark.sparkContext.broadcast(
        (
            counts,
            (counts > 0) & (counts == best_b[np.where((same >= 0) & (same < len(best_b)), same, 0)]),
            top_code,
            top_n,
            top_n == best_b[top_code & 0xFFFFFFFF],
            best_b,
        )
    )

    def weigh(batches):
        counts, counts_best, top_code, top_n, top_best, _ = shared.value
        for batch in batches:
            at = batch.schema.get_field_index
            ids, n = _flat(batch, "same", "same_n")
            doc = np.repeat(np.arange(batch.num_rows), batch.column(at("same")).value_lengths().to_numpy())
            total, best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, doc, n * counts[ids])
            np.add.at(best, doc, n * counts_best[ids])
            codes, n = _flat(batch, "pair", "pair_n")
            doc = np.repeat(np.arange(batch.num_rows), batch.column(at("pair")).value_lengths().to_numpy())
            place = np.searchsorted(top_code, codes)
            found = np.zeros(len(codes), bool)
            if len(top_code):
                found = top_code[np.minimum(place, len(top_code) - 1)] == codes
                np.add.at(total, doc[found], n[found] * top_n[place[found]])
                np.add.at(best, doc[found], n[found] * top_best[place[found]])
            rare = ~found
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=batch.num_rows))]).astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[rare])) for x in (codes, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(at("row")), pa.array(total), pa.array(best), *left], names=["row", "total", "best", "pair", "pair_n"]
            )

    known = stored(
        rows.select("row", "same", "same_n", "pair", "pair_n").mapInArrow(
            weigh, "row long, total long, best long, pair array<long>, pair_n array<long>"
        ),
        "weighed",
    )
    b = F.explode(F.arrays_zip("pair", "pair_n")).alias("x")
    rare = known.select("row", b).select("row", F.col("x.pair").alias("pair"), F.col("x.pair_n").alias("times"))
    most = spark.createDataFrame([(int(i), int(best_b[i])) for i in np.flatnonzero(best_b)], "b int, most long")
    rare_pairs = pairs.where(~frequent).join(F.broadcast(most), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    added = (
        rare.join(rare_pairs, "pair")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("n")).alias("total"), F.sum(F.col("times") * F.col("is_best")).alias("best"))
    )
    sums = known.select("row", "total", "best").union(added).groupBy("row").agg(F.sum("total").alias("count_sum"), F.sum("best").alias("n_best"))
    return rows.select("row", id, "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row").select(
        id, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
