"""Words and five-word shingles as 64-bit hashes, over batches of texts."""

from __future__ import annotations

import re

import numpy as np

#: Words of a shingle.
SHINGLE = 5
_WORD = re.compile(r"\w+")


class WordHashes:
    """Hash of a word. No word is kept: to hash it anew takes less time than to look it up."""

    def __init__(self) -> None:
        from xxhash import xxh3_64_intdigest

        self.of = xxh3_64_intdigest


def words(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower())


def spans(text: str) -> list[tuple[int, int]]:
    """Code-point spans of the words of a text: of text itself, as lower case can change lengths."""
    lower = text.lower()
    if len(lower) == len(text):
        return [m.span() for m in _WORD.finditer(lower)]
    at, places = [], []
    for i, c in enumerate(text):
        places += [i] * len(c.lower())
    places.append(len(text))
    for m in _WORD.finditer(lower):
        at.append((places[m.start()], places[m.end() - 1] + 1))
    return at


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(text: str, memo: WordHashes) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(memo.of, found), np.uint64, len(found))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hash of each run of five words; of all words where there are fewer; none of none."""
    size = min(SHINGLE, len(h))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out
