"""Whole Arrow string columns as one flat byte array, and numpy kernels over it.

Texts are never decoded one by one: the kernels see the UTF-8 bytes of a batch with offsets of its
documents. Words are maximal runs of bytes other than ASCII punctuation, blanks and control
characters, so that any letter beyond ASCII belongs to a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel takes at once; a longer document is a chunk of its own.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[b for b in range(128) if not chr(b).isalnum()]] = False
_powers: dict[str, np.ndarray] = {}


def power(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the hash base (or of its inverse) modulo 2^64; as many as a chunk needs are kept for the worker's life, those of a longer text are not."""
    kept = _powers.get(key := "inverse" if inverse else "base")
    if kept is None or len(kept) < n:
        x = np.full(max(n, CHUNK + 65536), _INVERSE if inverse else _BASE, np.uint64)
        x[0] = 1
        made = np.multiply.accumulate(x)
        if kept is None:
            _powers[key] = made[: CHUNK + 65536].copy()
        return made[:n]
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs stay equal, others are spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Gives freed memory back to the machine, as a worker stays idle for long beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of the column, and joins small ones up to that."""
    waiting: list[pa.RecordBatch] = []
    held = 0

    def joined() -> pa.RecordBatch:
        return waiting[0] if len(waiting) == 1 else pa.concat_batches(waiting)

    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most - held, "right")) - 1
            end = min(max(end, start + 1 if not waiting else start), batch.num_rows)
            if end > start:
                waiting.append(batch.slice(start, end - start))
                held += int(offsets[end] - offsets[start])
                start = end
            if start < batch.num_rows or held >= most:
                yield joined()
                waiting, held = [], 0
    if waiting:
        yield joined()
    waiting.clear()
    release()


def spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of set flags; a run ends where its document does."""
    n = len(flags)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flags[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    before[firsts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flags[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the number of words at the end)."""
    starts, ends = spans(_IS_WORD[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power(len(data)), out=total[1:])
    return total


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans from the running hash; equal bytes give equal hashes wherever they stand."""
    return mix((total[ends] - total[starts]) * power(len(total), True)[starts])


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams inside documents, and each document's first n-gram (with the end).

    A document of fewer than n words, but of one at least, has its whole word list as its only n-gram."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(hashes))
    left = first[1:][doc] - at
    short = count < n
    gram = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        inside = left > k
        part = np.zeros(len(hashes), np.uint64)
        part[inside] = hashes[at[inside] + k] + np.uint64(k + 1)
        gram = mix(gram * np.uint64(_BASE) + part)
    keep = (left >= n) | (short[doc] & (at == first[:-1][doc]))
    sizes = np.bincount(doc[keep], minlength=len(count))
    return gram[keep], np.concatenate([[0], np.cumsum(sizes)])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each document's slice; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
