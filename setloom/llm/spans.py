"""Words of UTF-8 texts as byte spans, found and fingerprinted by numpy over the bytes of Arrow batches.

A fingerprint is a Rabin-Karp one from prefix polynomials modulo 2**64: with P the running sum of value * BASE**place,
any span's hash is (P[end] - P[start]) * BASE**-start, so that all words, and all runs of words, of a chunk cost a few
passes over arrays. Equal spans have equal fingerprints; different ones may rarely share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import mixed

#: Bytes of a chunk; a longer text is cut into several.
CHUNK = 1 << 18
BASE, OVER_WORDS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32
#: A 64-bit value for each byte.
VALUES = mixed(np.arange(1, 257, dtype="u8") * np.uint64(0xD1B54A32D192ED03))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, "u8")

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate((np.ones(1, "u8"), np.cumprod(np.full(size - 1, x, "u8")))) for x in (self.base, self.inverse))
        return self.up, self.down


BYTE_POWERS, WORD_POWERS = Powers(BASE), Powers(OVER_WORDS)


def prefix_polynomial(values: np.ndarray, powers: Powers) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, "u8")
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_prints(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Fingerprint of each span [start, end): a mix of its polynomial and its length."""
    _, down = powers.upto(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype("u8"))


def byte_set(accepted: str) -> np.ndarray:
    """Table of 256 flags from ASCII characters."""
    flags = np.zeros(256, bool)
    flags[list(accepted.encode())] = True
    return flags


@dataclass
class Chunk:
    """Words of some rows of a batch, or of a part of one long row."""

    data: np.ndarray  # the bytes, A-Z in lower case
    starts: np.ndarray  # of each word
    ends: np.ndarray
    rows: np.ndarray  # row of the batch of each word
    own: int  # words that start in this chunk; later ones are there to complete runs of words
    places: np.ndarray  # byte of its text at which each word starts
    part: bool  # of a row that has several chunks

    def prints(self) -> np.ndarray:
        return span_prints(prefix_polynomial(np.take(VALUES, self.data), BYTE_POWERS), self.starts, self.ends, BYTE_POWERS)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _next(data: np.ndarray, flags: np.ndarray, at: int) -> int:
    """First place from `at` on whose byte is flagged, or the end."""
    step = 1 << 12
    while at < len(data):
        found = flags[data[at : at + step]]
        if found.any():
            return at + int(found.argmax())
        at, step = at + step, step * 2
    return len(data)


def _word_edges(data: np.ndarray, in_word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that do not cross the bounds of rows."""
    if not len(data):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    inside = np.take(in_word, data)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    if len(cuts):
        edges = np.sort(np.concatenate((edges, cuts, cuts)))
    edges = np.concatenate((np.zeros(int(inside[0]), "i8"), edges, np.full(int(inside[-1]), len(data))))
    return edges[::2], edges[1::2]


def chunks(texts: pa.Array, in_word: np.ndarray, ahead: int = 0, size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a string array of about `size` bytes; parts of a long row are cut between words, with `ahead` words of
    the next part at their end. Nulls are empty texts."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8")
    ends = np.cumsum(lengths)
    raw = texts.buffers()[2]
    kind = "i8" if pa.types.is_large_string(texts.type) else "i4"
    first = int(np.frombuffer(texts.buffers()[1], kind, 1, texts.offset * np.dtype(kind).itemsize)[0]) if len(texts) else 0
    data = np.frombuffer(raw, "u1", int(ends[-1]), first) if len(texts) and ends[-1] else np.zeros(0, "u1")
    outside = ~in_word
    row = 0
    while row < len(texts):
        low = int(ends[row] - lengths[row])
        if lengths[row] > size:
            whole = data[low : int(ends[row])]
            at = 0
            while at < len(whole):
                cut = _next(whole, outside, min(at + size, len(whole)))
                stop = cut
                for _ in range(ahead):
                    stop = _next(whole, outside, _next(whole, in_word, stop))
                held = np.take(LOWER, whole[at:stop])
                s, e = _word_edges(held, in_word, np.zeros(0, "i8"))
                yield Chunk(held, s, e, np.full(len(s), row), int(np.searchsorted(s, cut - at)), s + at, True)
                at = cut
            row += 1
            continue
        stop = max(row + 1, int(np.searchsorted(ends, low + size, "right")))
        while stop > row + 1 and lengths[stop - 1] > size:
            stop -= 1
        held = np.take(LOWER, data[low : int(ends[stop - 1])])
        bounds = ends[row:stop] - low
        s, e = _word_edges(held, in_word, bounds)
        rows = np.repeat(np.arange(row, stop), np.diff(np.searchsorted(s, bounds), prepend=0))
        yield Chunk(held, s, e, rows, len(s), s - (ends[rows] - lengths[rows] - low), False)
        row = stop
