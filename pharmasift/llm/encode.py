"""Tokenizing whole texts by their words, with each new word encoded once per task.

Both vocabularies split a text into words before they merge letters, and white space
always ends a word. So a text is cut at ASCII white space, the pieces are looked up, and
only pieces not seen before go to the tokenizer: plain words straight to its merge model,
everything else (digits, symbols, quotes, special strings) through its full pipeline.
The result equals encoding the whole text, which tests check on random texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

#: Bytes of text looked at together: missing words are encoded in one batch.
GROUP_BYTES = 512 * 1024
#: Estimated bytes of remembered pieces; the memory is emptied beyond it, which changes no result.
MEMORY_BYTES = 64 * 1024 * 1024
#: Longer pieces (whole paragraphs in scripts without spaces) are encoded anew each time.
LONG_PIECE = 64

_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
#: Letters (ASCII and Latin-1), then ASCII symbols other than the apostrophe, up to the end.
_PLAIN = re.compile(rb"( ?" + _LETTERS + rb")([!-&(-/:-@\[-`{-~]*)")
_SPACED = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: A place where every word pattern ends a token: visible ASCII, then ASCII white space.
_SAFE = re.compile(rb"(?<=[!-~])(?=[\t-\r ])")
#: First bytes of white space beyond ASCII, in UTF-8.
_OTHER_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: itself if printable, else 256, 257, ..."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def spaced_pieces(text: bytes) -> list[bytes]:
    """Words with the white space before them, for vocabularies whose words start with a space."""
    if any(x in text for x in _OTHER_SPACE):
        return _SAFE.split(text)
    return _SPACED.findall(text)


def bare_pieces(text: bytes) -> list[bytes]:
    """Words without white space, for vocabularies that drop white space and letter case."""
    return (text if b"<|" in text else text.lower()).split()


def slices(text: bytes, limit: int = GROUP_BYTES) -> Iterator[bytes]:
    """The text in slices of about `limit` bytes, cut only at safe boundaries."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Words:
    """What `keep` makes of the ids of each piece; `known` remembers it."""

    def __init__(self, path: str, pieces: Callable, keep: Callable[[list[int]], Any], add: Callable):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.pieces, self.keep, self.add = pieces, keep, add
        self.lower = pieces is bare_pieces
        self.letters = byte_letters()
        self.known: dict[bytes, Any] = {}
        self.held = 0

    def spelled(self, word: bytes) -> str:
        """The word in the letters of the vocabulary; ASCII letters stand for themselves."""
        if self.lower:
            word = word.lower() if word.isascii() else word.decode().lower().encode()
        if word.isascii():
            return word.decode().replace(" ", self.letters[0x20])
        return "".join(map(self.letters.__getitem__, word))

    def learn(self, new: set[bytes]) -> None:
        known, keep, tokenize = self.known, self.keep, self.model.tokenize
        other = []
        for piece in new:
            plain = _PLAIN.fullmatch(piece)
            if not plain:
                other.append(piece)
                continue
            word, tail = plain.groups()
            value = known.get(word)
            if value is None and len(word) > LONG_PIECE:
                value = keep([t.id for t in tokenize(self.spelled(word))])
            elif value is None:
                value = known[word] = keep([t.id for t in tokenize(self.spelled(word))])
            if tail:
                end = known.get(tail)
                if end is None:
                    end = keep(self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids)
                    if len(tail) <= LONG_PIECE:
                        known[tail] = end
                value = self.add([value, end])
            known[piece] = value
        if other:
            texts = [piece.decode() for piece in other]
            for piece, e in zip(other, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                known[piece] = keep(e.ids)

    def encode(self, texts: list[bytes]) -> list[Any]:
        """For each text the joined values of its pieces."""
        if self.held > MEMORY_BYTES:
            self.known.clear()
            self.held = 0
        cut = [self.pieces(text) for text in texts]
        new, before = set().union(*cut).difference(self.known), len(self.known)
        self.learn(new)
        values = [self.add(map(self.known.__getitem__, pieces)) for pieces in cut]
        for piece in new:
            if len(piece) > LONG_PIECE:
                del self.known[piece]
        self.held += 150 * (len(self.known) - before) + 5 * sum(len(p) for p in new if len(p) <= LONG_PIECE)
        return values


def grouped(texts: Iterator[tuple[Any, bytes]], limit: int = GROUP_BYTES) -> Iterator[list[tuple[Any, bytes]]]:
    """(key, slice) lists balanced by bytes; a long text is spread over several lists."""
    group, size = [], 0
    for key, text in texts:
        for part in slices(text, limit):
            group.append((key, part))
            size += len(part)
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group
