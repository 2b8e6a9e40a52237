"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

The tokenizer used here drops white space before its merges, so a text's ids are those of its words in order. A worker keeps
the ids of the words that it has seen twice as packed bytes, in a table of bounded size that is emptied when full; words seen once, most of which never come
again, wait in a smaller one.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

MODEL = "word_bpe_49k.json"
#: The end id after each document.
END = 1
#: Words in a worker's table, and words seen once that wait beside it.
WORDS, ONCE = 250_000, 50_000


#: A lower-case Latin-1 word and what follows it; both are pre-tokens of their own.
LETTERS = "a-zß-öø-ÿ"
WORD = re.compile(rf"([{LETTERS}]+)([^\s0-9A-Za-zª²³µ¹º¼-¾À-ÖØ-öø-ÿ\u0100-\U0010ffff]*)")


def is_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next unused one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


def packed(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class WordEncoder(dict):
    """ids(text) for a byte-level tokenizer that normalises to NFC and lower case and splits into letters, digits and the rest.

    Latin-1 texts are lower-cased before the look-up, and their plain words go straight to the library's model; all else, and any text
    with the start of a special token, goes through the library's whole pipeline word by word. The dict holds the packed ids of words seen twice.
    """

    def __init__(self, path: str, words: int = WORDS, once: int = ONCE) -> None:
        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit, self.once_limit = words, once
        self.once: dict[str, bytes] = {}
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.byte = byte_letters()

    def words(self, text: str) -> list[str]:
        if "<|" not in text and (text.isascii() or is_latin_1(text)):
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def _whole(self, word: str) -> bytes:
        return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join([self.byte[b] for b in word.encode()])
        return packed([x.id for x in self.model.tokenize(word)])

    def __missing__(self, word: str) -> bytes:
        found = self.once.pop(word, None)
        if found is not None:
            self[word] = found
            return found
        if word.isascii() and word.isalpha() and word.islower():
            found = packed([x.id for x in self.model.tokenize(word)])
        elif parts := WORD.fullmatch(word):
            letters, mark = parts.groups()
            if mark:
                found = self[letters] + (self[mark] if mark in self else self._whole(mark))
            else:
                found = self._letters(letters)
        else:
            found = self._whole(word)
        if len(self.once) >= self.once_limit:
            self.once = {}
        self.once[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without an end id."""
        if len(self) > self.limit:
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, self.words(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker and path; later tasks of the worker use it again."""
    return WordEncoder(path)


def default_path() -> str:
    return public_tokenizers.path(MODEL)
