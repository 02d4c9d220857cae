"""MD5 of many short texts that differ in a number, by NumPy: what resampling draws by hash."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SINES = [int(abs(math.sin(k + 1)) * 2**32) & 0xFFFFFFFF for k in range(64)]
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in four]
WORDS = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts of one pass, whose arrays stay in the processor's cache.
SLAB = 16_384


def digits_in(at: int, first: int, last: int) -> dict[int, np.ndarray]:
    """The decimal digits of first, ..., last - 1, all of one length, as they stand in a block's words from byte ``at`` on."""
    out: dict[int, np.ndarray] = {}
    rest = np.arange(first, last, dtype=np.int64)
    for p in range(len(str(first)) - 1, -1, -1):
        rest, digit = np.divmod(rest, 10)
        word = (digit + 48).astype(np.uint32) << np.uint32(8 * ((at + p) % 4))
        out[(at + p) // 4] = out[(at + p) // 4] | word if (at + p) // 4 in out else word
    return out


def heads(block: list[int], digits: dict[int, np.ndarray], many: int) -> np.ndarray:
    """The first 32 bits of the MD5 of one-block texts: the words of ``block``, with ``digits`` added to some."""
    a, b, c, d = (np.full(many, x, np.uint32) for x in START)
    t, u = np.empty(many, np.uint32), np.empty(many, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif k < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif k < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        t += np.uint32((SINES[k] + block[WORDS[k]]) & 0xFFFFFFFF)
        if (more := digits.get(WORDS[k])) is not None:
            t += more
        np.left_shift(t, np.uint32(SHIFTS[k]), out=u)
        t >>= np.uint32(32 - SHIFTS[k])
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    a += np.uint32(START[0])
    return a.byteswap()


class Numbered:
    """The first 32 bits of the MD5 of <before><k><after> for k from 0 to n."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        edges = [0, *(10**p for p in range(1, len(str(n)) + 1))]
        self.spans = [(s, min(s + SLAB, b, n)) for a, b in zip(edges, edges[1:]) for s in range(a, min(b, n), SLAB)]

    def draws(self, before: str, after: str) -> np.ndarray:
        left, right = before.encode(), after.encode()
        if len(left) + len(str(self.n)) + len(right) > 55:  # more than one block
            return np.array([int(hashlib.md5(b"%b%d%b" % (left, k, right)).hexdigest()[:8], 16) for k in range(self.n)], np.uint32)
        out, at = np.empty(self.n, np.uint32), len(left)
        for first, last in self.spans:
            if (at, first) not in self.known:
                self.known[at, first] = digits_in(at, first, last)
            many = len(str(first))
            size = at + many + len(right)
            text = left + bytes(many) + right + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
            out[first:last] = heads(np.frombuffer(text, "<u4").tolist(), self.known[at, first], last - first)
        return out
