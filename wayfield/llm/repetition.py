"""Operator 1: quality rule on repetition inside a document, by suffix array and longest-common-prefix intervals.

The suffixes of all documents of a batch are sorted together by prefix doubling over words (only suffixes
that aren't told apart yet are sorted again); a suffix never reaches beyond its document. Neighbours in
that order share their longest common prefix, found from the ranks of all doublings. An interval of
neighbours that share LEAST words or more is a repeated substring that can't go on to the right; if its occurrences don't all
follow the same word either, it is a maximal repeated substring, and counts as one of n_repeats. The union of all
occurrences' spans is what repeats. A document passes if that covers at most COVERED of the bytes of its words and the
longest repeat has at most LONGEST words.

Words are compared without regard to case. Defined results: null and empty texts and texts without words
have no repeats and pass; overlapping occurrences count; null doc_ids, repeated rows and further columns stay as they
are; if a column is called __repeats, the struct takes the next free name (__repeats_).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .shared import free, tune

LEAST, COVERED, LONGEST = 6, 0.9, 60


def suffix_order(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks after each doubling); equal ranks in list j: equal first 2^j words."""
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][doc]
    key = flat.mix(words ^ flat.mix(doc.astype(np.uint64)))
    order = np.argsort(key)
    rank = np.empty(n, np.int32)

    def regroup(slots: np.ndarray, suffixes: np.ndarray, new: np.ndarray) -> None:
        heads = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank[suffixes] = slots[heads]

    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    regroup(np.arange(n), order, new)
    levels, slots, k = [rank.copy()], np.arange(n), 1
    while True:
        lone = new & np.append(new[1:], True)
        slots, suffixes = slots[~lone], order[slots[~lone]]
        if not len(slots):
            return order, levels
        beyond = suffixes + k
        second = np.where(beyond < end[suffixes], rank[np.minimum(beyond, n - 1)], -1).astype(np.int64) + 1
        key = rank[suffixes].astype(np.int64) << 32 | second
        by = np.argsort(key, kind="stable")
        key, suffixes = key[by], suffixes[by]
        order[slots] = suffixes
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        regroup(slots, suffixes, new)
        levels.append(rank.copy())
        k *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], first: np.ndarray, least: int) -> np.ndarray:
    """For each place in the order, how many words it shares with the place before, where that is ``least`` at least, otherwise 0."""
    n = len(order)
    out = np.zeros(n, np.int64)
    low = least.bit_length() - 1
    if low >= len(levels) or n < 2:
        return out
    at = np.flatnonzero(levels[low][order[1:]] == levels[low][order[:-1]]) + 1
    a, b = order[at - 1].astype(np.int64), order[at].astype(np.int64)
    end = first[np.searchsorted(first, a, "right")]
    shared = np.zeros(len(at), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < end) & (y < end)
        equal = inside & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
        shared[equal] += 1 << j
    out[at] = np.where(shared >= least, shared, 0)
    return out


def intervals(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last) of each interval of suffixes that share shared[place] words and aren't part of one that shares as many: suffixes first to last of the order."""
    places = np.flatnonzero(shared)
    before = np.maximum(np.arange(len(shared)) - 1, 0)
    todo = places
    while len(todo):
        # before[p] always skips only larger values, so a jump from a larger value's place is safe
        todo = todo[shared[before[todo]] > shared[todo]]
        before[todo] = before[before[todo]]
    places = places[shared[before[places]] < shared[places]]
    closed = np.append(shared, -1)
    after = np.minimum(np.arange(len(closed)) + 1, len(shared))
    todo = np.flatnonzero(shared)
    while len(todo):
        todo = todo[closed[after[todo]] >= closed[todo]]
        after[todo] = after[after[todo]]
    return places, before[places], after[places] - 1


def maximal(shared: np.ndarray, order: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the intervals whose suffixes don't all follow the same word; a document's start is unlike any word."""
    places, low, high = intervals(shared)
    previous = np.where(order > 0, words[order - 1], np.uint64(0))
    heads = np.isin(order, first[:-1])
    other = np.ones(len(order), bool)
    other[1:] = (previous[1:] != previous[:-1]) | heads[1:] | heads[:-1]
    changes = np.cumsum(other)
    return places[changes[high] > changes[low]]


def repeats(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: covered fraction of its words' bytes, words of the longest repeat, number of maximal repeats."""
    starts, ends, first = flat.words(data, offsets)
    docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(docs), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    hashes = flat.word_hash(data, starts, ends)
    order, levels = suffix_order(hashes, first)
    shared = common_prefixes(order, levels, first, least)
    longest = np.zeros(len(order) + 1, np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    where = np.flatnonzero(longest)
    steps = np.zeros(len(order) + 1, np.int64)
    np.add.at(steps, where, 1)
    np.add.at(steps, where + longest[where], -1)
    covered = np.cumsum(steps)[:-1] > 0
    size = ends - starts
    fraction = flat.sums(size * covered, first) / np.maximum(flat.sums(size, first), 1)
    most = np.zeros(docs, np.int64)
    doc = np.searchsorted(first, where, "right") - 1
    np.maximum.at(most, doc, longest[where])
    many = np.bincount(np.searchsorted(first, order[maximal(shared, order, hashes, first)], "right") - 1, minlength=docs)
    return fraction, most, many


def measure(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All columns of docs, with struct ``__repeats`` of covered_fraction, longest_repeat and n_repeats."""
    tune(docs.sparkSession)
    kind = T.StructType().add("covered_fraction", "double").add("longest_repeat", "long").add("n_repeats", "long")
    lower, own_name = free(docs.columns, "__lower", "__repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.chunks(batches, lower):
            own = repeats(*flat.flat(batch.column(lower)), least)
            own = pa.StructArray.from_arrays([pa.array(x) for x in own], names=kind.names)
            yield pa.record_batch([*batch.columns[:-1], own], names=[*batch.schema.names[:-1], own_name])

    return docs.withColumn(lower, F.lower("text")).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own_name, kind)]))


def passing(docs: DataFrame) -> DataFrame:
    """The measured documents that pass the rule."""
    (own,) = free(docs.columns, "__repeats")
    return measure(docs).where((F.col(f"{own}.covered_fraction") <= COVERED) & (F.col(f"{own}.longest_repeat") <= LONGEST))
