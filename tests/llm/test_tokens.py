"""Token counts and packing against the tokenizer applied to whole texts."""

import random
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pharmasift.llm import encode, packing, token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "a", "It's the dog's, they're 'so'.  Two  spaces\n\nand\ttabs ", "İstanbul ΑΣ ΣΑΣ. straße ÀÉ é fi",
    "x <|endoftext|> y<|endoftext|> z  <|startoftext|>", "<|STARTOFTEXT|> A", "a  b  c  d\x1c e\x85 f", "don't 'twas 'S foo'ś",
    "word### other%%%, (x) [y] a|b | c", "12 3456,78 +1 (545) 555", "日本語 のテキスト", "\U0001f600 ok \U0001f469‍\U0001f680", "\x00a \x0b b\x0c",
    "ªº µ aª", "tail  ", "\n", " lead", "A,B .C", "!!! a!!! !!", "é ́e", "'", "''s", "a' s", "n' t", "'re a're",
]


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def by_pieces(words, text, limit=encode.GROUP_BYTES):
    return words.add([words.encode([part])[0] for part in encode.slices(text.encode(), limit)])


def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_hard_texts_like_the_library(byte, word, limit):
    counts = encode.Words(BYTE, encode.spaced_pieces, len, sum)
    ids = encode.Words(WORD, encode.bare_pieces, packing.packed_ids, b"".join)
    for text in [*HARD, " ".join(HARD), "".join(HARD)]:
        assert by_pieces(counts, text, limit) == len(whole(byte, text)), text
        assert by_pieces(ids, text, limit) == packing.packed_ids(whole(word, text)), text


ALPHABET = "aAbstrevml dD  \n\t'’.,!|#<>-éÉßÿ×÷ñ1 2  ́ 　\x85\x1cσΣİ日"


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=40) | st.text(max_size=30))
def test_any_text_like_the_library(byte, word, text):
    counts = encode.Words.__new__(encode.Words)
    counts.__dict__.update(_COUNTS.__dict__)
    assert by_pieces(counts, text, 9) == len(whole(byte, text))
    ids = encode.Words.__new__(encode.Words)
    ids.__dict__.update(_IDS.__dict__)
    assert by_pieces(ids, text, 9) == packing.packed_ids(whole(word, text))


_COUNTS = encode.Words(BYTE, encode.spaced_pieces, len, sum)
_IDS = encode.Words(WORD, encode.bare_pieces, packing.packed_ids, b"".join)


def test_counts_of_rows(spark, byte):
    long = "abc def, " * 100_000
    rows = [(1, "a b"), (2, None), (2, ""), (3, long), (None, "x"), (4, "a b"), *((10 + i, t) for i, t in enumerate(HARD))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'x' AS n_bytes", "2 AS _text")
    found = sorted(map(tuple, token_counts.count_tokens(docs, BYTE).collect()), key=str)
    expected = []
    for i, text in rows:
        n = len(whole(byte, text or ""))
        expected.append((i, len((text or "").encode()), n, n > 512))
    assert found == sorted(expected, key=str)
    assert token_counts.count_tokens(docs.limit(0), BYTE).collect() == []


def test_memory_of_words_may_be_emptied(monkeypatch, byte):
    monkeypatch.setattr(encode, "MEMORY_BYTES", 300)
    counts = encode.Words(BYTE, encode.spaced_pieces, len, sum)
    for text in HARD * 2:
        assert by_pieces(counts, text) == len(whole(byte, text))


def check_packing(packed, texts, word, capacity):
    """Whole documents, gapless sequences, right ids."""
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = whole(word, text or "") + [1]
        pieces = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [
            (k, k * capacity, min(capacity, len(ids) - k * capacity)) for k in range(-(-len(ids) // capacity))
        ]
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert not by_doc
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("task_items", [20_000, 25])
def test_packing_is_whole_and_tight(spark, word, monkeypatch, task_items):
    monkeypatch.setattr(packing.pack, "__defaults__", ("item", "length", packing.CAPACITY, task_items))
    draw = random.Random(3)
    texts = {i: " ".join(draw.choice(["dog", "cats", "unbelievable", "a"]) for _ in range(draw.choice([1, 5, 40, 200]))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "dog " * 700, 1003: "a " * 63, 1004: "a " * 64, 1005: "a " * 127}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS row", "3 AS length")
    packed = packing.pack_documents(docs, WORD, capacity=64).collect()
    n = check_packing(packed, texts, word, 64)
    least = -(-sum(r.length for r in packed) // 64)
    assert n <= least * (1.05 if task_items > 1000 else 1.2)


def test_packing_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    packed = packing.pack_documents(docs, WORD).collect()
    assert sorted((str(r.doc_id), r.length) for r in packed) == [("1", 3), ("1", 3), ("None", 2)]
    assert len({(r.sequence_id, r.offset) for r in packed}) == 3
    assert packing.pack_documents(docs.limit(0), WORD).collect() == []


def test_best_fit_takes_the_tightest_bin():
    placed = packing.best_fit([6, 5, 4, 3], 10)
    assert placed == [(0, 0), (1, 0), (0, 6), (1, 5)]


def test_word_memory_is_bounded_in_bytes(byte):
    """Long pieces without spaces are not remembered, and short ones only up to a number of bytes."""
    words = encode.Words(BYTE, encode.spaced_pieces, len, sum)
    draw = random.Random(4)
    han = ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(300)) for _ in range(50)]
    assert words.encode([" ".join(han[:25]).encode(), "\n".join(han[25:]).encode()]) == [
        len(whole(byte, " ".join(han[:25]))), len(whole(byte, "\n".join(han[25:])))
    ]
    assert sum(map(len, words.known)) < 10_000
    long = ("x" * 100 + "!" * 100) + " " + "y" * 100
    assert words.encode([long.encode()] * 2) == [len(whole(byte, long))] * 2
    assert all(len(p) <= encode.LONG_PIECE for p in words.known)


def test_forgetting_changes_nothing(byte, monkeypatch):
    monkeypatch.setattr(encode, "MEMORY_BYTES", 300)
    words = encode.Words(BYTE, encode.spaced_pieces, len, sum)
    for text in HARD * 2:
        assert words.encode([text.encode()])[0] == len(whole(byte, text))
    assert words.held <= 5000
