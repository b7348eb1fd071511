"""Exact token ids from a tokenizers-library file, fast on repetitive text.

The library's own steps are kept apart: a text is normalised and cut into
pre-tokens as the file says, and the library's model turns each distinct
pre-token into ids once. What lies within Latin-1 is cut by a pattern here
(below U+0100 the character classes are fixed and NFC changes nothing); other
texts are cut at blanks, where no pre-token crosses, and what is not Latin-1
goes through the library's normaliser and cutter. Texts with special strings
go to the library whole. What a worker remembers is bounded by bytes.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

from ._common import Memo

# Letters, numbers and white space below U+0100.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
BLANKS = "\t\n\x0b\x0c\r \x85\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

_SPACED = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|{CONTRACTIONS}| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
_WORDS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|{CONTRACTIONS}|[^{BLANKS}{LETTERS}{NUMBERS}]+")
_BLANKS_MEET = re.compile(r"\s\s")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes
    stand for themselves, the others follow from U+0100 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_LETTER_OF_BYTE = _byte_letters()


def byte_level(piece: str) -> str:
    if piece.isascii():
        if piece.isalnum():
            return piece
        if piece[0] == " " and piece[1:].isalnum():
            return _LETTER_OF_BYTE[32] + piece[1:]
    return piece.encode().decode("latin-1").translate(_LETTER_OF_BYTE)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes.

    keep_space: the vocabulary's pieces hold the blank before a word
    (byte-level); otherwise texts are lower-cased and white space is dropped
    (word ends). ``remembered`` bounds the bytes of the pre-tokens kept.
    """

    def __init__(self, path: str, keep_space: bool, remembered: int = 96 << 20):
        self.tokenizer, self.keep_space = load(path), keep_space
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Memo(f"ids of {path}", self._ids, remembered)

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's own answer for whole texts."""
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def _latin(self, text: str) -> list[str]:
        return _SPACED.findall(text) if self.keep_space else _WORDS.findall(text.lower())

    def cut(self, text: str) -> list:
        """A text's pre-tokens; beyond Latin-1 they stand in the letters for
        bytes, each in a tuple, and all others as they are."""
        if is_latin(text):
            return self._latin(text)
        if self.keep_space:
            head, *rest = _BETWEEN.split(text) if _BLANKS_MEET.search(text) else text.split(" ")
            chunks = [head, *(" " + x for x in rest)]
        else:
            chunks = text.replace("\n", " ").split(" ")
        normal, cutter, found = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, []
        for chunk in chunks:
            if is_latin(chunk):
                found += self._latin(chunk)
            else:
                found += [(x,) for x, _ in cutter.pre_tokenize_str(normal.normalize_str(chunk) if normal else chunk)]
        return found

    def _ids(self, pre_token) -> bytes:
        letters = pre_token[0] if isinstance(pre_token, tuple) else byte_level(pre_token)
        ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        self.known.begin()
        get = self.known.__getitem__
        return [self.whole([t])[0] if self.special(t) else b"".join(map(get, self.cut(t))) for t in texts]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keep_space: bool) -> Encoder:
    """The worker's encoder, kept between batches and tasks."""
    if (path, keep_space) not in _encoders:
        _encoders[path, keep_space] = Encoder(path, keep_space)
    return _encoders[path, keep_space]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
