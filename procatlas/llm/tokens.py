"""Token ids of whole texts, and how long they are."""

from __future__ import annotations

import codecs
import re
import struct

from procatlas.llm.store import per_process
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

# A byte-level BPE never merges across the place where a run of blanks and line feeds begins, nor between a letter or a
# digit and a mark that ends the word. So a text is the sequence of its chunks. Only texts whose white space is nothing but
# these two characters are cut that way.
_SIMPLE = "A-Za-zÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(rf"[ \n]*(?:[{_SIMPLE}0-9]+(?=[.,;:!?](?:[ \n]|\Z))|[^ \n]+)|[ \n]+")
_MARKS = tuple(".,;:!?")
_WORD_CHARS = re.compile(rf"[{_SIMPLE}0-9]+")
_ONE_WORD = re.compile(rf" ?[{_SIMPLE}]+")
_FORMATS = [f"<{n}I" for n in range(33)]
_OTHER_SPACE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _byte_letters() -> str:
    """How byte-level vocabularies write each byte: those that have no visible character by letters from 256 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in visible)}
    return "".join(chr(letters.get(byte, byte)) for byte in range(256))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(_FORMATS[len(ids)] if len(ids) < len(_FORMATS) else f"<{len(ids)}I", *ids)


class _Chunks(dict):
    """Ids of each chunk seen, as little-endian unsigned 32-bit integers; emptied when ``limit`` is reached."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def kept(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        return self.kept(chunk, self.encode(chunk))


class _Spaced(_Chunks):
    """Ids of what stands between two blanks, with the blank before it; a word shares its ids with the word and its mark."""

    def __init__(self, chunks: _Chunks, word, limit: int):
        super().__init__(word, limit)
        self.chunks = chunks

    def __missing__(self, piece: str) -> bytes:
        if _ONE_WORD.fullmatch(piece):
            return self.kept(piece, self.encode(" " + piece))
        if "\n" in piece:
            return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(" " + piece)))
        if piece[-1:] in _MARKS and _WORD_CHARS.fullmatch(piece, 0, len(piece) - 1):
            return self.kept(piece, self[piece[:-1]] + self.chunks[piece[-1]])
        return self.kept(piece, self.chunks.encode(" " + piece))


class Encoder:
    """Encodes texts with a vocabulary file of the ``tokenizers`` library, without special tokens.

    Each distinct chunk is encoded once per process, and a chunk that is one word goes to the library's model without the
    steps before it; a text with other white space than blanks and line feeds, or with the literal text of an added
    token, is encoded whole. All give the ids of the whole text.
    """

    def __init__(self, vocabulary: str, memo: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters, self.words = _byte_letters(), self.tokenizer.model.tokenize
        sample = " Größe"
        self.plain = self.tokenizer.normalizer is None and self._word(sample) == self._whole(sample)
        self.chunks = _Chunks(self._chunk, memo // 8)
        self.spaced = _Spaced(self.chunks, self._word if self.plain else self._whole, memo)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        return _packed([t.id for t in self.words(codecs.charmap_decode(word.encode(), "strict", self.letters)[0])])

    def _chunk(self, chunk: str) -> bytes:
        return self._word(chunk) if self.plain and _ONE_WORD.fullmatch(chunk) else self._whole(chunk)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; null and empty texts have none."""
        if not text:
            return b""
        if _OTHER_SPACE.search(text) or any(token in text for token in self.added):
            return self._whole(text)
        if "  " in text or "\n " in text or text[-1] == " ":  # runs of white space in which a blank is not the first
            return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))
        first, *rest = text.split(" ")
        lead = b"".join(map(self.chunks.__getitem__, _CHUNK.findall(first)))
        return lead + b"".join(map(self.spaced.__getitem__, rest))


def encoder(vocabulary: str) -> Encoder:
    """The process's encoder of a vocabulary file."""
    return per_process("encoder", vocabulary, lambda: Encoder(vocabulary))
