"""Exact per-text counts over ASCII-white-space words: lengths, symbols, repeated lines and windows."""

from __future__ import annotations

import numpy as np

from .common import mix64

# The characters counted as symbols, and the white space that separates words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8
#: Unrelated odd multipliers for the positions in a window of word numbers.
_WEIGHTS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def symbols(text: str) -> int:
    """Characters of SYMBOLS."""
    return sum(text.count(c) for c in SYMBOLS)


def word_chars(text: str) -> int:
    """Code points outside white space."""
    return len(text) - sum(text.count(c) for c in SPACES)


def duplicate_lines(raw: bytes) -> int:
    r"""Lines (split at \n) with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more; ids number the distinct words."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    x, h = ids.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h += x[i : i + n] * _WEIGHTS[i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    found = np.nonzero(np.isin(h, twice))[0]
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())
