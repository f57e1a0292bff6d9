"""Token alignment against whole texts encoded and compared pair by pair."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pharmasift.llm import alignment
from pharmasift.llm.encode import byte_letters

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "  ", "a", " a", "a ", "Hello world.\n\n  foo\tbar  ", "x <|endoftext|> y <s> z </s> <unk>", "a▁b", "▁", "日本語 のテキスト", "Straße é é  ü",
    "\x00a \x0b\x1c b", "{\r }\r\n x", "tail  \n", "\U0001f600 ok", "é    x", "don't it's", "the the the of the", "ÃÃ ×÷ x", "a\u0085 b",
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: bytes([i]) for i, c in byte_letters().items()}
    bytes_a = {i: b"".join(letters.get(c) or c.encode() for c in t) for t, i in a.get_vocab().items()}
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, bytes_a, bytes_b


def plain(tools, text):
    """Ids of A, ids of B, groups and links by comparing the byte ranges of whole texts."""
    a, b, bytes_a, bytes_b = tools
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(bytes_a[i] for i in x) != (" " + text).encode() or b"".join(bytes_b[i] for i in y) != (" " + text).encode():
        return None
    ends = []
    for ids, table in ((x, bytes_a), (y, bytes_b)):
        at, found = 0, []
        for i in ids:
            at += len(table[i])
            found.append(at)
        ends.append(found)
    common = sorted(set(ends[0]) & set(ends[1]))
    by_group = [[[] for _ in common] for _ in ends]
    for side, ids, found in zip(by_group, (x, y), ends):
        for i, e in zip(ids, found):
            side[bisect_left(common, e)].append(i)
    groups = [f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in zip(*by_group)]
    ends_b: dict = {}
    for j, f in zip(y, ends[1]):
        ends_b.setdefault(f, []).append(j)
    links = [(i, j) for i, e in zip(x, ends[0]) for j in ends_b.get(e, [])]
    return len(x), len(y), groups, links


def plain_table(tools, docs):
    done = [(d, plain(tools, t)) for d, t in docs]
    count = Counter(link for _, p in done if p for link in p[3])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d, p in done:
        if p is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = p
            out.append(
                (d, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                 hashlib.sha256(";".join(groups).encode()).hexdigest())
            )
    return sorted(out, key=str)


def result(docs, frequent_part):
    df = alignment.align(docs, A, B, frequent_part=frequent_part)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("frequent_part", [alignment.FREQUENT_PART, 20])
def test_like_whole_texts(spark, tools, frequent_part):
    """With a small part most pairs take the shuffle; null and repeated ids, other columns."""
    random.seed(3)
    letters = "abe tion The of  é\n日.,'#1"
    docs = [(i, t) for i, t in enumerate(HARD)] + [(None, "the of"), (5, "the of"), (5, "again the")]
    docs += [(100 + i, "".join(random.choices(letters, k=random.randrange(60)))) for i in range(60)]
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, row string, n_a int")
    assert result(rows, frequent_part) == plain_table(tools, docs)


def test_given_documents(spark, tools):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs, 5000) == plain_table(tools, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("aAbe tT\n\t'.#{\r1é×▁ \x85日<|s>", max_size=40) | st.text(max_size=30))
def test_pieces_like_whole_texts(tools, text):
    found = _ALIGNER.document(text.encode()) if text else None
    expected = plain(tools, text)
    if expected is None:
        assert found is None
    else:
        n_a, n_b, groups, links = expected
        assert found[:4] == (n_a, n_b, len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
        mine = Counter({(i, _ALIGNER.same[i]): n for i, n in found[4].items()}) + Counter({(c >> 32, c & 0xFFFFFFFF): n for c, n in found[5].items()})
        assert mine == Counter(links)


def test_long_text_in_slices_and_forgetting(monkeypatch):
    text = ("word other é ü naïve x. " * 3000).encode()
    whole = alignment.Aligner(A, B).document(text)
    monkeypatch.setattr(alignment, "MEMORY_BYTES", 1)
    monkeypatch.setattr(alignment.slices, "__defaults__", (100,))
    assert alignment.Aligner(A, B).document(text) == whole


_ALIGNER = alignment.Aligner(A, B)
