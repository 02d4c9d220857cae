"""Pre-tokens of the byte-level vocabularies: the usual split pattern as array operations.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

No text is split one by one: a table gives the class of each code point of a whole batch, and every
alternative of the pattern is a condition on a code point and its neighbours.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points of Unicode's White_Space property.
BLANK = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[BLANK] = SPACE
    return table


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of all pre-tokens with the end, each document's first pre-token with the end)."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    ascii_only = bool(lead.all()) and int(data.max()) < 128
    at = np.arange(n) if ascii_only else np.flatnonzero(lead)
    code = data if ascii_only else np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    m = len(code)
    doc_first = offsets[:-1][np.diff(offsets) > 0]
    begins = np.zeros(m + 1, bool)
    begins[doc_first if ascii_only else np.searchsorted(at, doc_first)] = True
    begins[m] = True
    head = begins[:-1]
    before = np.empty(m, np.uint8)
    before[0] = SPACE
    before[1:] = kind[:-1]
    changed = kind != before
    after_blank = np.zeros(m, bool)
    after_blank[1:] = code[:-1] == 32
    after_blank &= ~head
    space = kind == SPACE
    # the last white space before something else stands alone, or goes with it if it is a blank
    followed = np.zeros(m, bool)
    followed[:-1] = ~space[1:] & ~begins[1:m]
    start = head | (~space & changed & ~after_blank) | (space & (changed | followed))
    quote = np.flatnonzero((code == 39) & (head | ((before != OTHER) & ~after_blank)))
    if len(quote):
        room = np.searchsorted(np.flatnonzero(begins), quote, "right")
        room = np.flatnonzero(begins)[room] - quote  # code points left in the document
        one, two = (code[np.minimum(quote + k, m - 1)] for k in (1, 2))
        single = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
        double = (room > 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for hit, k in ((quote[single], 2), (quote[double], 3)):
            start[hit + 1] = False
            nxt = hit + k
            nxt = nxt[nxt < m]
            # what is left of a run of letters is a pre-token of its own
            start[nxt[kind[nxt] == LETTER]] = True
    firsts = np.flatnonzero(start)
    cuts = np.append(at[firsts], n)
    return cuts, np.searchsorted(cuts[:-1], offsets)


def unique_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct pre-token, for each occurrence the number of its distinct one); bytes are compared."""
    from . import flat

    starts, ends = cuts[:-1], cuts[1:]
    hashes = flat.word_hash(data, starts, ends)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    which = np.empty(len(order), np.int64)
    which[order] = group
    index = order[new]
    # one hash with other bytes is possible, if unlikely: those occurrences become distinct by themselves
    length = ends - starts
    like = index[which]
    bad = length[like] != length
    where = np.repeat(starts[like] - starts, length) + np.arange(len(data))
    unequal = data[np.minimum(where, len(data) - 1)] != data
    if unequal.any():
        bad |= np.add.reduceat(unequal, starts) > 0 if len(starts) else bad
    for k in np.flatnonzero(bad):
        which[k] = len(index)
        index = np.append(index, k)
    return index, which
