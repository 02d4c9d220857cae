"""Operator 2: byte-level BPE encoding and decoding by batched merge rounds.

The distinct pre-tokens of a batch stand as symbols in one flat array. In each round every pre-token
merges its pair of lowest rank, wherever it stands (from the left where pairs overlap); ranks are found by
binary search over the sorted keys of all pairs that join to a token, and only for pairs that are new.
Decoding gathers the bytes of all tokens of a batch at once.

Defined results: a null text has null tokens, an empty one an empty list, and null token lists decode to
null; special tokens' strings are ordinary text; null doc_ids, repeated rows and further columns stay as they are;
if one of these is called tokens or round_trip, the result's column takes the next free name (tokens_).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import flat
from .pretoken import split, unique_spans
from .shared import free, tune

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 1 << 20
NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Vocabulary:
    """pairs: sorted keys left << 32 | right; ranks: the token each joins to; bytes: id of each single byte; data, at: all tokens' bytes."""

    pairs: np.ndarray
    ranks: np.ndarray
    bytes: np.ndarray
    data: np.ndarray
    at: np.ndarray


def load(path: str = VOCABULARY) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    found = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                found[left << 32 | right] = rank
    keys = np.array(sorted(found), np.int64)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in table])])
    return Vocabulary(keys, np.array([found[k] for k in keys.tolist()], np.int32), single, np.frombuffer(b"".join(table), np.uint8), at)


def merge_rounds(v: Vocabulary, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many words: symbols of single bytes, each word's first one (with the end); returns tokens and the same offsets of theirs."""

    def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        return np.where(v.pairs[at] == key, v.ranks[at], NONE)

    words = len(first) - 1
    word = np.repeat(np.arange(words, dtype=np.int32), np.diff(first))
    rank = np.full(len(symbols), NONE, np.int32)
    if len(symbols) > 1:
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = rank_of(symbols[inner], symbols[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        head = np.empty(len(word), bool)
        head[0] = True
        head[1:] = word[1:] != word[:-1]
        starts = np.flatnonzero(head)
        least = np.minimum.reduceat(rank, starts)
        group = np.cumsum(head) - 1
        over = (least == NONE)[group]
        if over.any():
            done.append((word[over], symbols[over]))
            live = ~over
            symbols, word, rank, least = symbols[live], word[live], rank[live], least[group[live]]
            if not len(symbols):
                break
        else:
            least = least[group]
        hit = rank == least
        # of overlapping pairs of the same rank every other one merges, from the left
        run = hit.copy()
        run[1:] &= hit[:-1] & (word[1:] == word[:-1])
        if run.any():
            places = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(hit & ~run, places, 0))
            hit &= (places - begin) % 2 == 0
        at = np.flatnonzero(hit)
        symbols = symbols.copy()
        symbols[at] = rank[at]
        stale = np.zeros(len(symbols), bool)
        stale[at] = True
        stale[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        # the symbol before a removed one is new as well when two merges touch
        symbols, word, rank, stale = symbols[keep], word[keep], rank[keep], stale[keep]
        back = np.flatnonzero(stale[1:]) if len(stale) > 1 else np.empty(0, np.int64)
        stale[back] = True
        last = np.ones(len(word), bool)
        last[:-1] = word[1:] != word[:-1]
        rank[stale & last] = NONE
        todo = np.flatnonzero(stale & ~last)
        rank[todo] = rank_of(symbols[todo], symbols[todo + 1])
    if not done:
        return np.empty(0, np.int32), np.zeros(words + 1, np.int64)
    word, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(word, kind="stable")
    return symbols[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=words))])


def gather(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices ``which`` of values[at[k]:at[k + 1]], one after another, and their offsets."""
    many = at[which + 1] - at[which]
    out = np.concatenate([[0], np.cumsum(many)])
    return values[np.repeat(at[which] - out[:-1], many) + np.arange(out[-1])], out


def encode_batch(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all documents, and each document's first one (with the end)."""
    cuts, first = split(data, offsets)
    if len(cuts) == 1:
        return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
    index, which = unique_spans(data, cuts)
    raw, at = gather(data, cuts, index)
    tokens, of = merge_rounds(v, v.bytes[raw], at)
    out, ends = gather(tokens, of, which)
    return out, ends[first]


def decode_batch(v: Vocabulary, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all documents, and offsets."""
    data, at = gather(v.data, v.at, tokens)
    return data, at[offsets]


def _list(tokens: np.ndarray, offsets: np.ndarray, missing: np.ndarray | None) -> pa.Array:
    mask = pa.array(missing) if missing is not None else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens), mask=mask)


def encode(docs: DataFrame, path: str = VOCABULARY, check: bool = False, name: str = "tokens") -> DataFrame:
    """docs with the array ``name`` of token ids instead of the text; with ``check`` also with ``round_trip``: whether they decode to the text's bytes."""
    tune(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))
    names = [c for c in docs.columns if c != "text"]
    name, trip = free(names, name, "round_trip")
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"]).add(name, T.ArrayType(T.IntegerType()))
    schema = schema.add(trip, "boolean") if check else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in flat.chunks(batches, most=CHUNK):
            column = batch.column("text")
            data, offsets = flat.flat(column)
            tokens, first = encode_batch(v, data, offsets)
            missing = np.asarray(column.is_null()) if column.null_count else None
            columns = [*(batch.column(c) for c in names), _list(tokens, first, missing)]
            if check:
                back, at = decode_batch(v, tokens, first)
                same = np.diff(at) == np.diff(offsets)
                if len(back) != len(data) or not np.array_equal(back, data):
                    same = np.array([back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(at, at[1:], offsets, offsets[1:])], bool)
                columns.append(pa.array(same, mask=missing))
            yield pa.record_batch(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str = VOCABULARY, tokens: str = "tokens", name: str = "text") -> DataFrame:
    """df with the text of its token lists; bytes that aren't UTF-8 by themselves become replacement characters."""
    tune(df.sparkSession)
    vocabulary = df.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([f for f in df.schema.fields if f.name != name]).add(name, "string")
    names = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            lists = batch.column(tokens)
            ids = np.asarray(lists.flatten())
            first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            data, at = decode_batch(v, ids, first)
            texts = [None if gone else data[a:b].tobytes().decode("utf-8", "replace") for gone, a, b in zip(lists.is_null().to_pylist(), at, at[1:])]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
