"""Operator 5: licence scan by an exact set-similarity join of text blocks with licence templates.

A block is a run of one to SPAN lines, so that notices broken over lines are found; its set is its distinct lower-cased words. It
matches a template if it holds at least ``t`` of the template's distinct words (containment), and is reported if no shorter
block inside it matches as well. The words of the templates are ordered by how often they occur in the whole corpus, the rarest
first. An inverted index leads from a word to the templates that have it, and three filters keep most blocks out:

* prefix: of a template of n words, needing m, a match must hold one of the first n - m + 1; only lines near such an anchor are looked at;
* length: m words that templates have must stand near the anchor;
* position: the rarest common word of a match has all the others behind it, in the template and in the block, so that
  m words must be left from its place on in either of them.

What passes is counted in full. The join is exact: it finds what holding every block against every template would.

Defined results: null and empty texts have no blocks; equal rows and equal blocks each have their own
matches; a null doc_id stays null; templates without words match nothing; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import tune

CONTAINED, SPAN = 0.8, 8
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All rights reserved": "Copyright, all rights reserved.",
    "All rights reserved, alone": "All rights reserved.",
}


def words_of(text: str) -> list[str]:
    """Distinct words, sorted; as :func:`flat.words` has them."""
    return sorted(set(re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", text.lower())))


class Vocabulary:
    """The distinct words of all templates, by hash."""

    def __init__(self, templates: dict[str, str]):
        self.words = sorted({w for t in templates.values() for w in words_of(t)})
        column = pa.array(self.words, pa.string())
        data, at = flat.flat(column)
        hashes = flat.word_hash(data, at[:-1], at[1:]) if len(self.words) else np.empty(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[hashes >> np.uint64(48)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, numbers of words) of those that are in the vocabulary."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(48)])
        if not len(at) or not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        near = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        true = self.hashes[near] == hashes[at]
        return at[true], self.order[near[true]]


def frequencies(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Occurrences of each word of the vocabulary in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in flat.chunks(batches):
            data, offsets = flat.flat(batch.column("text"))
            starts, ends, _ = flat.words(data, offsets)
            total += np.bincount(vocabulary.find(flat.word_hash(data, starts, ends))[1], minlength=len(total))
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    out = np.zeros(len(vocabulary.words), np.int64)
    for r in texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


@dataclass(frozen=True)
class Index:
    """From words to templates: for word w the entries first[w] to first[w + 1] with template, and place in its order.

    rank: place of each word in the global order; size and need: words of each template, and how many a match has."""

    first: np.ndarray
    template: np.ndarray
    place: np.ndarray
    rank: np.ndarray
    size: np.ndarray
    need: np.ndarray

    @staticmethod
    def of(vocabulary: Vocabulary, templates: list[str], often: np.ndarray, t: float) -> Index:
        rank = np.empty(len(often), np.int64)
        rank[np.lexsort((np.arange(len(often)), often))] = np.arange(len(often))
        number = {w: k for k, w in enumerate(vocabulary.words)}
        rows = []
        sizes = []
        for k, text in enumerate(templates):
            own = sorted((number[w] for w in words_of(text)), key=lambda w: rank[w])
            rows += [(w, k, p) for p, w in enumerate(own)]
            sizes.append(len(own))
        word, template, place = (np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else (np.empty(0, np.int64),) * 3
        size = np.array(sizes, np.int64)
        return Index(np.searchsorted(word, np.arange(len(often) + 1)), template, place, rank, size, np.ceil(t * size - 1e-9).astype(np.int64))

    def entries(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words, entry) of all templates that have these words."""
        many = self.first[word + 1] - self.first[word]
        which = np.repeat(np.arange(len(word)), many)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.first[word][which]


def anchors(index: Index, doc: np.ndarray, line: np.ndarray, word: np.ndarray, passed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template, document, line) of the words, sorted by document and line, that can be the rarest common one of a match; passed: gets how many pass each filter."""
    at = doc << 32 | line
    which, entry = index.entries(word)
    template, place = index.template[entry], index.place[entry]
    need = index.need[template]
    keep = place <= index.size[template] - need
    which, template, place, need = which[keep], template[keep], place[keep], need[keep]
    counts = [len(which)]
    low = np.searchsorted(at, np.maximum(at[which] - SPAN + 1, doc[which] << 32))
    high = np.searchsorted(at, at[which] + SPAN - 1, "right")
    keep = high - low >= need
    which, template, place, need, low, high = (x[keep] for x in (which, template, place, need, low, high))
    counts.append(len(which))
    many = high - low
    owner = np.repeat(np.arange(len(which)), many)
    near = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + low[owner]
    behind = np.bincount(owner, index.rank[word[near]] >= index.rank[word[which]][owner], len(which))
    keep = (behind >= need) & (index.size[template] - place >= need)
    counts.append(int(keep.sum()))
    if passed is not None:
        passed[:] = counts
    return template[keep], doc[which[keep]], line[which[keep]]


def matches_of(vocabulary: Vocabulary, index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, line, lines, template, common words) of all matches in a batch."""
    none = (np.empty(0, np.int64),) * 5
    starts, ends, _ = flat.words(data, offsets)
    at, word = vocabulary.find(flat.word_hash(data, starts, ends))
    breaks = np.flatnonzero(data == 10)
    doc = np.searchsorted(offsets, starts[at], "right") - 1
    line = np.searchsorted(breaks, starts[at]) - np.searchsorted(breaks, offsets[:-1])[doc]
    if not len(at):
        return none
    doc, line, word = np.unique(np.stack([doc, line, word], axis=1), axis=0).T
    template, where, near = anchors(index, doc, line, word)
    if not len(template):
        return none
    # words of anchored templates in anchored documents, no further than a block from the anchor
    own = np.flatnonzero(np.isin(doc, where))
    which, entry = index.entries(word[own])
    key = lambda k, d, n: (k * len(offsets) + d) << 32 | n
    anchor = np.unique(key(template, where, near))
    here = key(index.template[entry], doc[own][which], line[own][which])
    after = np.minimum(np.searchsorted(anchor, here), len(anchor) - 1)
    close = (np.abs(anchor[after] - here) < SPAN) | (np.abs(anchor[np.maximum(after - 1, 0)] - here) < SPAN)
    here, bit = here[close], index.place[entry][close]
    # one row for each template and line, with a bit for each of the template's words
    rows, row = np.unique(here, return_inverse=True)
    mask = np.zeros((len(rows), int(index.size.max()) // 64 + 1), np.uint64)
    np.bitwise_or.at(mask, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    which_template = (rows >> 32) // len(offsets)
    need = index.need[which_template]
    behind = np.zeros_like(mask)  # words of the block's lines but the first
    open_ = np.arange(len(rows))
    out = []
    for lines in range(1, SPAN + 1):
        if lines > 1:
            found = np.minimum(np.searchsorted(rows, rows[open_] + lines - 1), len(rows) - 1)
            there = rows[found] == rows[open_] + lines - 1
            behind[open_[there]] |= mask[found[there]]
        common = np.bitwise_count(mask[open_] | behind[open_]).sum(axis=1, dtype=np.int64)
        done = common >= need[open_]
        least = done & (np.bitwise_count(behind[open_]).sum(axis=1, dtype=np.int64) < need[open_])
        out.append((rows[open_[least]], np.full(int(least.sum()), lines), common[least]))
        open_ = open_[~done]
    code, lines, common = (np.concatenate(x) for x in zip(*out))
    k, d = np.divmod(code >> 32, len(offsets))
    return d, code & 0xFFFFFFFF, lines, k, common


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, t: float = CONTAINED) -> DataFrame:
    """(doc_id, line, lines, license, containment) of every block and template it holds: its first line, counted from 0, and how many it has."""
    tune(docs.sparkSession)
    texts = docs.select("doc_id", F.lower("text").alias("text")).where("text is not null")
    vocabulary = Vocabulary(templates)
    index = Index.of(vocabulary, list(templates.values()), frequencies(texts, vocabulary), t)
    names = np.array(list(templates), object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.chunks(batches):
            doc, line, lines, which, common = matches_of(vocabulary, index, *flat.flat(batch.column("text")))
            containment = np.round(common / np.maximum(index.size[which], 1), 6) if len(which) else np.empty(0)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(doc)), pa.array(line), pa.array(lines), pa.array(names[which], pa.string()), pa.array(containment)], names=["doc_id", "line", "lines", "license", "containment"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, line long, lines long, license string, containment double")


def sql(templates: dict[str, str] = TEMPLATES, t: float = CONTAINED) -> str:
    """The same join in DuckDB's SQL: words by line, then blocks from each line on that has a template's word."""
    rows = ", ".join("('{}', ['{}'])".format(k, "', '".join(words_of(v))) for k, v in templates.items())
    return rf"""
WITH templates(license, w) AS (VALUES {rows}),
wanted AS (SELECT license, len(w) AS size, ceil({t} * len(w) - 1e-9) AS need, unnest(w) AS word FROM templates),
split AS (SELECT row_number() OVER () AS r, doc_id, string_split(lower(text), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT r, doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS block FROM split),
words AS (SELECT r, doc_id, line, unnest(list_distinct(regexp_extract_all(block, '[^\x00-/:-@\[-`{{-\x7f]+'))) AS word FROM blocks),
hits AS (SELECT r, doc_id, line, license, size, need, word FROM words JOIN wanted USING (word)),
starts AS (SELECT DISTINCT r, license, line FROM hits),
spans AS (
  SELECT h.r, h.doc_id, h.license, s.line, n AS lines, any_value(size) AS size, any_value(need) AS need, count(DISTINCT word) AS common, count(DISTINCT CASE WHEN h.line > s.line THEN word END) AS behind
  FROM starts s, (SELECT unnest(range(1, {SPAN + 1})) AS n) JOIN hits h ON h.r = s.r AND h.license = s.license AND h.line BETWEEN s.line AND s.line + n - 1
  GROUP BY ALL),
shortest AS (SELECT *, row_number() OVER (PARTITION BY r, license, line ORDER BY lines) AS k FROM spans WHERE common >= need)
SELECT doc_id, line::BIGINT AS line, lines::BIGINT AS lines, license, round(common / size, 6) AS containment FROM shortest WHERE k = 1 AND behind < need"""
