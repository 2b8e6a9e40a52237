"""Sets of hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
#: Bytes of texts whose words are hashed at once, but for a longer text: some ten numbers of 8 bytes are held for each.
AT_ONCE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, np.uint64(0xD6E8FEB86659FD93))]), dtype=np.uint64)
    return _POWERS


def word_hashes(texts: list[str], at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts, A-Z lower-cased, and how many words each text has. Words are runs of other than ASCII white space."""
    words, count, some, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0

    def add() -> None:
        for to, x in zip((words, count), _word_hashes(some), strict=True):
            to.append(x)

    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") + b" "
        if some and size + len(raw) > at_once:
            add()
            some, size = [], 0
        some.append(raw)
        size += len(raw)
    add()
    return np.concatenate(words), np.concatenate(count)


def _word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    white = _WHITE[flat]
    start = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    stop = np.flatnonzero(white & np.concatenate([[False], ~white[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    size = stop - start
    inside = np.flatnonzero(~white)
    first = np.cumsum(size) - size
    place = np.arange(len(inside)) - np.repeat(first, size)
    found = np.add.reduceat((flat[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place], first)
    ends = np.cumsum([len(r) for r in raw])
    return mixed(found + size.astype(np.uint64) * _STEP), np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The different shingles of each text, as ascending 64-bit hashes: of each width words in a row, or of all words where there are fewer."""
    words, count = word_hashes(texts)
    n = len(words)
    rows = np.zeros(n, np.uint64)
    for k in range(width):
        if k < n:
            rows[: n - k] += mixed(words[k:] + np.array([k + 1], np.uint64) * _STEP)
    rows = mixed(rows)
    found, at = [], 0
    for c in count.tolist():
        if c >= width:
            found.append(np.unique(rows[at : at + c - width + 1]))
        elif c:
            whole = c
            for k, w in enumerate(words[at : at + c].tolist()):
                whole = int(mixed(np.array([(whole * 31 + w + k) % (1 << 64)], np.uint64))[0])
            found.append(np.array([whole], np.uint64))
        else:
            found.append(np.zeros(0, np.uint64))
        at += c
    return found
