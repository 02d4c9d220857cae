"""Operator 3: token counts of a unigram tokenizer by dynamic programming over a trie of distinct pre-tokens.

All distinct pre-tokens of a batch stand in one trie of bytes. The best (cheapest) segmentation of a prefix
depends on nothing but the prefix, so it is computed once per node, level by level, whatever number of
pre-tokens share it; a terminal node holds its pre-token's token count, and a document's count is the sum
over its pre-tokens. The trie has the first LONE bytes of longer pre-tokens (unbroken Chinese, base64 and the like) as well; behind those
they hardly share prefixes, and each goes on by itself: the tokens that end at each of its bytes are found by array operations,
a window at a time, and one pass over these hits gives the scores.

Costs are whole numbers, a parameter: the cost of each rank. By default they are thousandths of -log p with p of a token of
rank r by Zipf's law, 1 / ((r + 1) H); of equally cheap segmentations the one of fewest tokens counts.

Defined results: null and empty texts have no tokens; null doc_ids, repeated rows and further columns
stay as they are; if one of these is called __counts, the struct takes the next free name (__counts_).
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import flat
from .bpe import VOCABULARY
from .pretoken import split, unique_spans
from .shared import free, tune

CHUNK = 1 << 20
#: The low bits of a node's value count tokens, of which a node has LONE at most; the others cost.
COUNT = 20
#: Depth of the trie, and bytes of a longer pre-token whose hits are found together.
LONE, WINDOW = 256, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEN = 20


@dataclass(frozen=True)
class Unigrams:
    """keys: sorted hashes of the tokens; values: cost << COUNT | 1 of each; lengths: bytes that tokens may have; seen: bits of hashes that occur."""

    keys: np.ndarray
    values: np.ndarray
    lengths: tuple[int, ...]
    seen: np.ndarray

    def find(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in codes, values) of those that are a token of this length."""
        key = flat.mix(codes + np.uint64(length))
        hit = np.flatnonzero(self.seen[key >> np.uint64(64 - _SEEN)])
        at = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
        true = self.keys[at] == key[hit]
        return hit[true], self.values[at[true]]


def zipf_costs(tokens: int) -> np.ndarray:
    ranks = np.arange(1, tokens + 1)
    return np.round(1000 * np.log(ranks * np.sum(1 / ranks))).astype(np.int64)


def vocabulary(tokens: dict[bytes, int]) -> Unigrams:
    """tokens: cost of each."""
    keys, values = [], []
    for token, cost in tokens.items():
        h = 0
        for b in token:
            h = (h * int(_BASE) + b + 1) & (2**64 - 1)
        keys.append(h)
        values.append(int(cost) << COUNT | 1)
    lengths = np.array([len(t) for t in tokens], np.uint64)
    hashes = flat.mix(np.array(keys, np.uint64) + lengths)
    order = np.argsort(hashes)
    seen = np.zeros(1 << _SEEN, bool)
    seen[hashes >> np.uint64(64 - _SEEN)] = True
    return Unigrams(hashes[order], np.array(values, np.int64)[order], tuple(sorted({len(t) for t in tokens})), seen)


def load(path: str = VOCABULARY, cost: Callable[[int], np.ndarray] = zipf_costs) -> Unigrams:
    """cost: of so many ranks, the cost of each."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    costs = cost(max(ranks.values()) + 1)
    return vocabulary({t: int(costs[r]) for t, r in ranks.items()})


def forward(v: Unigrams, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, tokens) of the best segmentation of each span; a vocabulary without some byte makes the cost very large."""
    value = shared_prefixes(v, data, starts, np.minimum(ends, starts + LONE))
    cost, tokens = value >> COUNT, value & ((1 << COUNT) - 1)
    for k in np.flatnonzero(ends - starts > LONE):
        cost[k], tokens[k] = alone(v, data[starts[k] : ends[k]])
    return cost, tokens


def alone(v: Unigrams, span: np.ndarray) -> tuple[int, int]:
    """(cost, tokens) of one long span."""
    deepest, shift = max(v.lengths, default=1), 40
    never = 1 << 100
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(deepest, _BASE, np.uint64)]))
    best = [0]  # of the prefix of each length; only the last ``deepest`` ones are still asked for
    for begin in range(0, len(span), WINDOW):
        end = min(begin + WINDOW, len(span))
        low = max(0, begin - deepest)
        own = span[low:end].astype(np.uint64) + np.uint64(1)
        ends_at, lengths, values = [], [], []
        code = np.zeros(len(own), np.uint64)
        asked = set(v.lengths)
        for length in range(1, min(deepest, len(own)) + 1):
            # of the ``length`` bytes from each place on
            code = code[: len(own) - length + 1] * _BASE + own[length - 1 :]
            if length in asked:
                at, value = v.find(code, length)
                stop = at + low + length
                new = stop > begin
                ends_at.append(stop[new])
                values.append(value[new])
                lengths.append(np.full(int(new.sum()), length))
        stop, length, value = (np.concatenate(x) for x in (ends_at, lengths, values))
        order = np.argsort(stop, kind="stable")
        first = np.searchsorted(stop[order], np.arange(begin + 1, end + 2)).tolist()
        length, value = length[order].tolist(), value[order].tolist()
        value = [(x >> COUNT << shift) + 1 for x in value]
        base = len(best) - 1 - begin
        for place in range(begin + 1, end + 1):
            a, b = first[place - begin - 1], first[place - begin]
            best.append(min([best[base + place - length[k]] + value[k] for k in range(a, b)], default=never))
        best = best[-deepest - 1 :]
    return best[-1] >> shift, best[-1] & ((1 << shift) - 1)


def shared_prefixes(v: Unigrams, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Value (cost << COUNT | tokens) of the best segmentation of each span of LONE bytes at most, by a trie of all of them."""
    never = np.int64(1) << np.int64(61)
    out = np.zeros(len(starts), np.int64)
    length = ends - starts
    by_length = np.argsort(-length, kind="stable")  # live spans are then a prefix of this order
    live_at = -np.sort(-length)
    node = np.zeros(len(starts), np.int64)  # of each span in that order, numbered within its level
    # what a level needs of the levels above: value, hash and parent of its nodes
    values, hashes, parents = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)]
    deepest = max(v.lengths, default=0)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(deepest, 1), _BASE, np.uint64)]))
    for depth in range(1, int(length.max(initial=0)) + 1):
        live = int(np.searchsorted(-live_at, -depth, "right"))
        own = by_length[:live]
        edge = node[:live] << 8 | data[starts[own] + depth - 1]
        edges, number = np.unique(edge, return_inverse=True)
        node[:live] = number
        parent = edges >> 8
        code = hashes[-1][parent] * _BASE + (edges & 255).astype(np.uint64) + np.uint64(1)
        best = np.full(len(edges), never)
        up = parent
        reach = 1
        for back in v.lengths:
            if back > depth:
                break
            while reach < back:
                up = parents[-reach][up]
                reach += 1
            hit, value = v.find(code - hashes[-back][up] * powers[back], back)
            if len(hit):
                best[hit] = np.minimum(best[hit], values[-back][up[hit]] + value)
        values.append(np.minimum(best, never))
        hashes.append(code)
        parents.append(parent)
        if len(values) > deepest + 1:
            values.pop(0), hashes.pop(0), parents.pop(0)
        done = int(np.searchsorted(-live_at, -depth, "left"))
        out[own[done:]] = values[-1][node[done:live]]
    return out


def count_batch(v: Unigrams, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: pre-tokens, tokens, cost."""
    cuts, first = split(data, offsets)
    if len(cuts) == 1:
        return (np.zeros(len(offsets) - 1, np.int64),) * 3
    index, which = unique_spans(data, cuts)
    cost, tokens = forward(v, data, cuts[:-1][index], cuts[1:][index])
    return np.diff(first), flat.sums(tokens[which], first), flat.sums(cost[which], first)


def counts(docs: DataFrame, path: str = VOCABULARY, cost: Callable[[int], np.ndarray] = zipf_costs) -> DataFrame:
    """docs with struct ``__counts`` of n_pretokens, n_tokens and cost (thousandths of -log p) instead of the text."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path, cost))
    kind = T.StructType().add("n_pretokens", "long").add("n_tokens", "long").add("cost", "long")
    fields = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in fields]
    (own_name,) = free(names, "__counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in flat.chunks(batches, most=CHUNK):
            own = count_batch(v, *flat.flat(batch.column("text")))
            own = pa.StructArray.from_arrays([pa.array(x) for x in own], names=kind.names)
            yield pa.record_batch([*(batch.column(c) for c in names), own], names=[*names, own_name])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(own_name, kind)]))
