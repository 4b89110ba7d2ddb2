"""Uniform numbers from MD5 digests of many short texts at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that fit one block, and digests that are made at once, so that they stay in a core's cache.
ONE, HELD = 55, 1 << 16


def _words(texts: list[bytes], at: int, size: int) -> np.ndarray:
    """Sixteen 32-bit words of a block for each of some texts of equal length, which stand at byte `at`."""
    rows = np.zeros((len(texts), 64), "u1")
    rows[:, at : at + size] = np.frombuffer(b"".join(texts), "u1").reshape(len(texts), size)
    return rows.view("<u4").astype("u4")


def _heads(starts: list[bytes], ends: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 digest of each end (row) of each start (column); starts have one length, and so have ends.

    A word of a block is the sum of what the start and the end have there, so no text is written out.
    """
    p, size = len(starts[0]), len(starts[0]) + len(ends[0])
    left, right = _words(starts, 0, p).T.copy(), _words(ends, p, len(ends[0]))
    right[:, size // 4] |= np.uint32(0x80 << 8 * (size % 4))
    right[:, 14] = 8 * size
    told = right.any(0)
    shape = (len(ends), len(starts))
    a, b, c, d = (np.full(shape, x, "u4") for x in _START)
    f, turned = np.empty(shape, "u4"), np.empty(shape, "u4")
    for i in range(64):
        turn = i // 16
        k = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += left[k] + np.uint32(_SINES[i])
        if told[k]:
            a += right[:, k, None]
        s = _SHIFTS[turn][i % 4]
        np.right_shift(a, np.uint32(32 - s), out=turned)
        np.left_shift(a, np.uint32(s), out=a)
        a |= turned
        a += b
        a, b, c, d = d, a, b, c
    return (a + np.uint32(_START[0])).byteswap(), (b + np.uint32(_START[1])).byteswap()


def uniforms(starts: list[str], ends: list[str]) -> np.ndarray:
    """A number from [0, 1) for each start (row) with each end (column): the first 52 bits of the text's MD5 digest."""
    heads, tails = [x.encode() for x in starts], [x.encode() for x in ends]
    out = np.empty((len(heads), len(tails)))
    by_size: tuple[dict[int, list[int]], ...] = ({}, {})
    for texts, found in zip((heads, tails), by_size):
        for i, x in enumerate(texts):
            found.setdefault(len(x), []).append(i)
    for p, rows in by_size[0].items():
        for s, columns in by_size[1].items():
            step = max(1, HELD // len(rows))
            for at in range(0, len(columns), step):
                some = columns[at : at + step]
                if p + s > ONE:
                    high = np.array([[int(hashlib.md5(heads[i] + tails[j]).hexdigest()[:13], 16) for i in rows] for j in some], "u8")
                else:
                    one, two = _heads([heads[i] for i in rows], [tails[j] for j in some])
                    high = (one.astype("u8") << np.uint64(20)) | (two >> np.uint32(12))
                out[np.ix_(rows, some)] = high.T / float(1 << 52)
    return out
