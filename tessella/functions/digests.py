"""First bits of the MD5 of many short texts at once, to leave out most of them before any digest is made in full."""

from __future__ import annotations

import math

import numpy as np

BLOCK, MOST = 64, 55  # bytes of a block; of a text that fits one
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
STEPS = 61  # the word that comes first in the digest isn't changed after that


def heads(texts: list[bytes]) -> np.ndarray:
    """Each text's words in a block that starts with it."""
    return np.frombuffer(b"".join(t.ljust(BLOCK, b"\0") for t in texts), dtype="<u4").reshape(len(texts), -1)


def tails(texts: list[bytes], at: int) -> np.ndarray:
    """Each text's words in a block that it ends, from a byte on: to be added to those of heads of that length."""
    end = [b"\0" * at + t + b"\x80" for t in texts]
    return np.frombuffer(b"".join(t.ljust(BLOCK - 8, b"\0") + (8 * (len(t) - 1)).to_bytes(8, "little") for t in end), dtype="<u4").reshape(len(texts), -1)


def first_bits(words: list[np.ndarray | None], n: int) -> np.ndarray:
    """The first 32 bits of the digests of n blocks, given word by word; None: zero."""
    a, b, c, d = (np.full(n, v, dtype=np.uint32) for v in START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(STEPS):
        turn, g = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
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
        a += SINES[i]
        a += f
        if words[g] is not None:
            a += words[g]
        s = SHIFTS[turn][i % 4]
        np.left_shift(a, np.uint32(s), out=t)
        a >>= np.uint32(32 - s)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    b += START[0]
    return b.byteswap()
