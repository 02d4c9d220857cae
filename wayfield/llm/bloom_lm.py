"""Operator 8: language-model scores from a log-frequency Bloom filter of the corpus's own word n-grams.

All unigrams and bigrams of all documents are counted. A count c is kept as its level 1 + floor(log2 c):
the n-gram goes into the filter once for each level up to that. Probing level after level until one is
missing gives the level back; the count is then taken as the middle of the level's range. A false positive can
only raise a level, and needs HASHES false bits for each.

    p(w | u) = L * min(1, c(u w) / c(u)) + (1 - L) * (c(w) + 1) / (N + V)     (without a u: the last factor)

The filter is cut into segments by the n-gram's hash, each made by one task from its own keys and sized by them, so that
it grows with the corpus at BITS bits per entry and no segment is larger than others. A filter has at most about as many bytes
as the texts, as an entry takes one and a word gives two n-grams. Where the texts have at most MOST bytes it is broadcast, and each
chunk of texts probes it for its distinct n-grams. Else the filter stays where its segments are: groups of texts send their distinct
n-grams there once, with their counts, from which the segments are made; these then send the levels back, with the same result.
There is a row for each group and segment, so that the work per row is small beside that per n-gram, at any number of segments.

Defined results: words are lower-cased; null, empty and wordless texts have 0 words and a null score; null
doc_ids, repeated rows and further columns stay as they are; if a column is called __lm, the struct takes
the next free name (__lm_).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .near import packed, unpacked
from .shared import free, swept, tune, written

BITS, HASHES, MIX, MOST = 8, 5, 0.7, 128 << 20
#: Entries that a task counts before it sends them on; bytes of text that make a group where the filter isn't broadcast.
HELD, GROUP = 3_000_000, 8 << 20
#: Row groups of few rows, as one row is a group of texts and writer and reader hold a whole row group.
ROWS_OF_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def word_key(word: np.ndarray) -> np.ndarray:
    """Key of a unigram; the last bit tells it from a bigram's."""
    return word & ~np.uint64(1)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return flat.mix(left * _PAIR + right) | np.uint64(1)


def hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of n-grams at a level from which all places of their bits follow."""
    first = flat.mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return first, flat.mix(first ^ _PAIR)


def place(first: np.ndarray, second: np.ndarray, k: int, size: np.ndarray) -> np.ndarray:
    """Bit of the k-th hash in a segment of ``size`` bits, fewer than 2^32."""
    return ((first + np.uint64(k) * second) >> np.uint64(32)) * size >> np.uint64(32)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def middle(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for; 0 for level 0."""
    return np.where(levels > 0, (3.0 * np.exp2(levels - 1.0) - 1) / 2, 0.0)


def segment(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(bits, bytes) of the filter of these n-grams."""
    levels = levels_of(counts)
    size = max(64, int(levels.sum()) * BITS)
    if size >= 2**32:
        raise ValueError("a segment of 512 MB; set spark.sql.shuffle.partitions higher")
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        h = hashed(keys[levels >= level], level)
        for k in range(HASHES):
            bits[place(*h, k, np.uint64(size))] = True
    return size, np.packbits(bits, bitorder="little").tobytes()


@dataclass(frozen=True)
class Filter:
    """Segments in one array: bytes, first byte and bits of each segment (0 bits: a segment without n-grams)."""

    data: np.ndarray
    first: np.ndarray
    bits: np.ndarray

    def levels(self, keys: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Level of each n-gram by repeated membership probes, all of one level before the next."""
        out = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(self.bits[where] > 0)
        keys, start, size = keys[live], self.first[where[live]].astype(np.uint64) << np.uint64(3), self.bits[where[live]].astype(np.uint64)
        level = 1
        while len(live):
            one, two = hashed(keys, level)
            for k in range(HASHES):
                at = start + place(one, two, k, size)
                hit = np.flatnonzero(self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1))
                if len(hit) < len(live):
                    live, keys, start, size, one, two = live[hit], keys[hit], start[hit], size[hit], one[hit], two[hit]
            out[live] = level
            level += 1
        return out


def assemble(rows: list[tuple[int, int, bytes]], buckets: int) -> Filter:
    first, bits, at = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), 0
    for number, size, blob in rows:
        first[number], bits[number] = at, size
        at += len(blob)
    return Filter(np.frombuffer(b"".join(r[2] for r in rows), np.uint8), first, bits)


def home_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segment of each n-gram; it grows with the key, so that sorted keys are sorted by segment."""
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int32)


@dataclass(frozen=True)
class Grams:
    """A chunk's words (hashes), first word of each document, and the place of each bigram's first word."""

    words: np.ndarray
    first: np.ndarray
    left: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Grams:
        data, offsets = flat.flat(column)
        starts, ends, first = flat.words(data, offsets)
        inner = np.ones(len(starts), bool)
        inner[first[1:][first[1:] > 0] - 1] = False
        return Grams(flat.word_hash(data, starts, ends), first, np.flatnonzero(inner))

    def keys(self) -> np.ndarray:
        """Keys of all unigrams, then of all bigrams."""
        return np.concatenate([word_key(self.words), pair_key(self.words[self.left], self.words[self.left + 1])])

    def scores(self, count: np.ndarray, n: int, kinds: int) -> pa.StructArray:
        """n_words and log2p of each document from the counts of :meth:`keys`."""
        one, two = count[: len(self.words)], count[len(self.words) :]
        base = (one + 1) / (n + kinds)
        each = np.log2(base)
        each[self.left + 1] = np.log2(MIX * np.minimum(1, two / np.maximum(one[self.left], 1)) + (1 - MIX) * base[self.left + 1])
        many = np.diff(self.first)
        return pa.StructArray.from_arrays([pa.array(many), pa.array(flat.sums(each, self.first), mask=many == 0)], names=["n_words", "log2p"])


COUNTED = "home int, number long, data binary"


def counted(keys: np.ndarray, segments: int, number: int) -> pa.RecordBatch:
    """A row for each segment that has some of these n-grams: the distinct ones in order, and their counts."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts, keys = np.diff(np.append(at, len(keys))).astype(np.int32), keys[at]
    homes, cut = np.unique(home_of(keys, segments), return_index=True)
    cut = [*cut.tolist(), len(keys)]
    blobs = [packed([keys[a:b], counts[a:b]]) for a, b in zip(cut, cut[1:])]
    return pa.record_batch([pa.array(homes), pa.array([number] * len(homes), pa.int64()), pa.array(blobs, pa.binary())], names=["home", "number", "data"])


def _count(segments: int):
    """Rows COUNTED of all texts; the number has no meaning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for batch in flat.chunks(batches):
            keys = Grams.of(batch.column("text")).keys()
            if not len(keys):
                continue
            held.append(keys)
            total += len(keys)
            if total > HELD:
                yield counted(np.concatenate(held), segments, 0)
                held, total = [], 0
        if held:
            yield counted(np.concatenate(held), segments, 0)

    return run


@dataclass(frozen=True)
class Home:
    """The n-grams of a segment with their counts in the corpus; and of each group that has some of them the number and, in its order, their places."""

    home: int
    keys: np.ndarray
    counts: np.ndarray
    groups: list[tuple[int, np.ndarray]]

    @staticmethod
    def of(home: int, numbers: list[int], blobs: list[bytes]) -> Home:
        parts = [unpacked(memoryview(x), ("u8", "i4")) for x in blobs]
        keys = np.concatenate([p[0] for p in parts])
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        counts = np.add.reduceat(np.concatenate([p[1] for p in parts])[order].astype(np.int64), np.flatnonzero(new))
        places = np.empty(len(keys), np.int64)
        places[order] = np.cumsum(new) - 1
        return Home(home, keys[new], counts, list(zip(numbers, np.split(places, np.cumsum([len(p[0]) for p in parts])[:-1]))))

    def unigrams(self) -> tuple[int, int]:
        """(number of words, of different ones)."""
        own = self.keys & np.uint64(1) == 0
        return int(self.counts[own].sum()), int(own.sum())


def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[Home]:
    """Segments, one after another, of rows COUNTED that are sorted by home."""
    at, numbers, blobs = None, [], []
    for batch in batches:
        for home, number, blob in zip(batch.column("home").to_pylist(), batch.column("number").to_pylist(), batch.column("data").to_pylist()):
            if home != at and blobs:
                yield Home.of(at, numbers, blobs)
                numbers, blobs = [], []
            at = home
            numbers.append(number)
            blobs.append(blob)
    if blobs:
        yield Home.of(at, numbers, blobs)
    flat.release()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, bits, filter, n, kinds) of each segment of this partition."""
    for x in homes(batches):
        bits, blob = segment(x.keys, x.counts)
        n, kinds = x.unigrams()
        yield pa.record_batch([pa.array([x.home], pa.int32()), pa.array([bits]), pa.array([blob], pa.binary()), pa.array([n]), pa.array([kinds])], names=["home", "bits", "filter", "n", "kinds"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, number, data, n, kinds): levels of each group's n-grams of a segment; n and kinds of the segment in its first row only."""
    for x in homes(batches):
        bits, blob = segment(x.keys, x.counts)
        levels = assemble([(0, bits, blob)], 1).levels(x.keys, np.zeros(len(x.keys), np.int64)).astype(np.uint8)
        more = [0] * (len(x.groups) - 1)
        n, kinds = x.unigrams()
        columns = [pa.array([x.home] * len(x.groups), pa.int32()), pa.array([g for g, _ in x.groups], pa.int64()), pa.array([levels[at].tobytes() for _, at in x.groups], pa.binary()), pa.array([n, *more]), pa.array([kinds, *more])]
        yield pa.record_batch(columns, names=["home", "number", "data", "n", "kinds"])


def by_home(rows: DataFrame, segments: int) -> DataFrame:
    """A segment for each partition."""
    return rows.repartitionById(segments, "home").sortWithinPartitions("home")


def filters(docs: DataFrame, segments: int) -> DataFrame:
    """Written rows of :func:`_build` of the whole corpus."""
    with swept(docs.sparkSession):
        rows = docs.select(F.lower("text").alias("text")).mapInArrow(_count(segments), COUNTED)
        return written(by_home(rows, segments).mapInArrow(_build, "home int, bits long, filter binary, n long, kinds long"), "lm-filters")


def totals(rows: DataFrame) -> tuple[int, int]:
    """(n, kinds) of the corpus."""
    return tuple(x or 0 for x in rows.agg(F.sum("n"), F.sum("kinds")).first())


KIND = T.StructType().add("n_words", "long").add("log2p", "double")


def broadcast_scores(docs: DataFrame, texts: DataFrame, segments: int, lower: str, own: str) -> DataFrame:
    """texts (docs with lower-cased texts as their last column) scored with the whole filter in each worker."""
    spark = docs.sparkSession
    rows = filters(docs, segments)
    n, kinds = totals(rows)
    got = [(r.home, r.bits, bytes(r.filter)) for r in rows.select("home", "bits", "filter").toLocalIterator()]
    shared = spark.sparkContext.broadcast(assemble(sorted(got), segments))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.chunks(batches, lower):
            g = Grams.of(batch.column(lower))
            keys, which = np.unique(g.keys(), return_inverse=True)
            count = middle(shared.value.levels(keys, home_of(keys, segments)))[which]
            yield pa.record_batch([*batch.columns[:-1], g.scores(count, n, kinds)], names=[*batch.schema.names[:-1], own])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields[:-1], T.StructField(own, KIND)]))


def sent_scores(texts: DataFrame, segments: int, lower: str, own: str) -> DataFrame:
    """The same where the filter may be too large to broadcast: groups send their distinct n-grams to the segments, which send the levels back.

    Groups are written once, compressed, under numbers of their own, so that a task that runs again finds the same ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in flat.chunks(batches, lower, most=GROUP):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.record_batch([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["number", "data"])
            number += 1

    def opened(blob: pa.Scalar) -> list[pa.RecordBatch]:
        """A group's texts in chunks."""
        return list(flat.chunks(iter([pa.ipc.open_stream(blob.as_buffer()).read_next_batch()]), lower))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("number").to_pylist(), batch.column("data")):
                keys = np.concatenate([Grams.of(chunk.column(lower)).keys() for chunk in opened(blob)])
                if len(keys):
                    yield counted(keys, segments, number)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First the answers to a group by their segments, which is the order of its distinct n-grams, then the group."""
        levels: list[bytes] = []
        for batch in batches:
            for home, blob in zip(batch.column("home").to_pylist(), batch.column("data")):
                if home is not None:
                    levels.append(blob.as_py())
                    continue
                chunks = opened(blob)
                grams = [Grams.of(chunk.column(lower)) for chunk in chunks]
                keys = [g.keys() for g in grams]
                ends = np.cumsum([len(k) for k in keys])
                _, which = np.unique(np.concatenate(keys), return_inverse=True)
                count = middle(np.frombuffer(b"".join(levels), np.uint8).astype(np.int64))
                levels.clear()
                for chunk, g, own_which in zip(chunks, grams, np.split(which, ends[:-1])):
                    yield pa.record_batch([*chunk.columns[:-1], g.scores(count[own_which], n, kinds)], names=[*chunk.schema.names[:-1], own])

    groups = written(texts.mapInArrow(cut, "number long, data binary"), "lm-groups", ROWS_OF_GROUPS)
    with swept(texts.sparkSession):
        answers = written(by_home(groups.mapInArrow(asked, COUNTED), segments).mapInArrow(_answer, COUNTED + ", n long, kinds long"), "lm-levels")
    n, kinds = totals(answers)
    back = answers.select("number", "home", "data").union(groups.select("number", F.lit(None).cast("int").alias("home"), "data"))
    back = back.repartition(segments, "number").sortWithinPartitions("number", F.col("home").asc_nulls_last())
    return back.mapInArrow(finish, T.StructType([*texts.schema.fields[:-1], T.StructField(own, KIND)]))


def score(docs: DataFrame, most: int = MOST, keep_text: bool = True) -> DataFrame:
    """All columns of docs (without the text unless it is kept) with struct ``__lm`` of n_words and log2p, the sum over the words."""
    spark = docs.sparkSession
    tune(spark)
    segments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lower, own = free(docs.columns, "__lower", "__lm")
    texts = docs.withColumn(lower, F.lower("text"))
    if not keep_text:
        texts = texts.drop("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return broadcast_scores(docs, texts, segments, lower, own) if size <= most else sent_scores(texts, segments, lower, own)
