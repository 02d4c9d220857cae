"""Operator 9: exact Jaccard join of word n-gram sets, with set relations that skip work.

Sets are the distinct 58-bit hashes of lower-cased word n-grams (a text of fewer than n words is one
n-gram). A global order (frequent n-grams last, then longer ones first) gives each set a prefix;
two sets of Jaccard ``t`` or more share a prefix element. Three kinds of skipping:

* equal sets are found by a 128-bit signature; one of them is joined, the others take over its answers;
* an inverted list is ordered by set size and position and cut into blocks, each with its greatest position, its most elements from
  a position on and its least size; a probe ends where sizes become too large, and skips whole blocks that these three rule out
  before it looks at entries; what is left must share enough prefix elements for the threshold, the first of them early enough in both sets;
* candidates are checked in chains of similar sets: the overlap with a set follows from the overlap
  with the set before it in the chain and the few elements by which the two differ.

:func:`linked` gives one row for each document that has a partner, with its class and how many partners it has; copies aren't
expanded into pairs. :func:`jaccard_join` gives each unordered pair once, as ``doc_a < doc_b``. Defined results: texts that are null or
have no word are in no pair; rows with a null doc_id are ignored; a repeated row counts once; a doc_id
with several texts is never paired with itself; an empty table gives no rows; other columns, whatever
their names, are ignored by the join and kept by :func:`drop_near_duplicates`; a doc_id that isn't a whole number is a TypeError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import free, small, tune, whole_ids, written

N, THRESHOLD = 2, 0.6
#: An n-gram in so many sets is frequent; this only changes the order, never the result.
FREQUENT, FREQUENT_KEYS = 20, 1_000_000
#: Keys of texts, pairs of list entries, or distinct pairs, that one step of a worker holds; sets of one block of the check; bytes of text taken at once.
HELD, SLAB, PAIRS, BLOCK, CHUNK = 2_000_000, 250_000, 1_000_000, 400, 1 << 20
#: Entries of a block of a list.
SKIP = 16
_HEAVY = np.uint64(1 << 63)


def least_overlap(sa, sb, t: float):
    """Common elements that sets of these sizes need for Jaccard t."""
    return np.ceil(t / (1 + t) * (sa + sb) - 1e-9)


class Frequent:
    """The frequent n-grams: their keys, those that put them last (by how frequent they are), and where their lists are kept."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, homes: np.ndarray):
        order = np.argsort(keys)
        self.keys, counts = keys[order], counts[order]
        rank = np.minimum(np.log2(np.maximum(counts, 1)) * 2, 63).astype(np.uint64)
        self.late = _HEAVY | rank << np.uint64(57) | (self.keys & np.uint64((1 << 57) - 1))
        by = np.argsort(self.late)
        self.sorted_late, self.homes = self.late[by], homes[order][by]

    def moved(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            keys = np.where(self.keys[at] == keys, self.late[at], keys)
        return keys

    def buckets(self, keys: np.ndarray, mixed: np.ndarray, buckets: int) -> np.ndarray:
        out = (mixed % np.uint64(buckets)).astype(np.int32)
        late = np.flatnonzero(keys >= _HEAVY)
        if len(late):
            out[late] = self.homes[np.searchsorted(self.sorted_late, keys[late])] % buckets
        return out


NO_FREQUENT = Frequent(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def keys_of(batch: pa.RecordBatch, n: int, frequent: Frequent) -> list[np.ndarray]:
    """The sorted distinct keys of each document; a key's order is its place in the global order."""
    data, offsets = flat.flat(batch.column("text"))
    starts, ends, first = flat.words(data, offsets)
    grams, at = flat.ngrams(flat.word_hash(data, starts, ends), first, n)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    left = first[1:][doc] - np.arange(len(starts))
    length = np.concatenate([np.minimum(ends - starts, 31), np.zeros(n, np.int64)])
    long = sum(np.where(left > k, length[k : k + len(starts)], 0) for k in range(n)) if len(starts) else np.empty(0, np.int64)
    long = long[(left >= n) | ((count < n)[doc] & (np.arange(len(starts)) == first[:-1][doc]))]
    keys = ((63 - np.minimum(long, 63)).astype(np.uint64) << np.uint64(57)) | (grams >> np.uint64(7))
    keys = frequent.moved(keys)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = np.sort(keys[a:b])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def prefix(size: int, t: float) -> int:
    return size - math.ceil(t * size - 1e-9) + 1


SURVEY = "doc_id long, sig binary, size int, key long, n long, low long"


def _survey(n: int):
    """Rows (doc_id, signature, size) of documents and (key, n, low) of n-grams that recur in this task; low: the least hash of a document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        total = 0
        names = ["doc_id", "sig", "size", "key", "n", "low"]

        def recurring() -> pa.RecordBatch:
            keys, low = np.concatenate(held), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            keys, low = keys[order], low[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            times, low, keys = np.diff(np.append(at, len(keys))), np.minimum.reduceat(low, at), keys[at]
            keys, low, times = (x[times >= 3] for x in (keys, low, times))
            nil = pa.nulls(len(keys))
            return pa.record_batch([nil.cast(pa.int64()), nil.cast(pa.binary()), nil.cast(pa.int32()), pa.array(keys.view(np.int64)), pa.array(times), pa.array(low)], names=names)

        for batch in flat.chunks(batches, most=CHUNK):
            sets = keys_of(batch, n, NO_FREQUENT)
            sizes = np.array([len(s) for s in sets], np.int32)
            at = np.concatenate([[0], np.cumsum(sizes)])
            both = [flat.mix(np.concatenate(sets) ^ np.uint64(salt)) for salt in (0, 0xA5A5A5A55A5A5A5A)]
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in both]
            sig = np.stack([s[at[1:]] - s[at[:-1]] for s in sums], axis=1)
            nil = pa.nulls(len(sets), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(sizes), nil, nil, nil], names=names)
            low = (flat.mix(np.asarray(batch.column("doc_id")).view(np.uint64)) >> np.uint64(2)).view(np.int64)
            for s, d in zip(sets, low):
                if len(s):
                    held.append(s)
                    owner.append(np.full(len(held[-1]), d))
                    total += len(held[-1])
            if total > HELD:
                yield recurring()
                held, owner, total = [], [], 0
        if held:
            yield recurring()

    return run


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns as planes of bytes, first bytes before second ones, so that zeros stand together and compress."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def unpacked(raw: memoryview, kinds: tuple[str, ...]) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(np.frombuffer(raw[at : at + n * width], np.uint8).reshape(width, n).T).view(kind)[:, 0])
        at += n * width
    return out


#: An entry of a list: 32 bits of the key (two keys may share a list), step from the last doc_id, size and position.
ENTRY = ("u4", "i8", "i4", "i4")


def _postings(n: int, t: float, frequent: Frequent, buckets: int):
    """Rows (bucket, blob): the prefix elements of many sets, packed for one bucket of keys.

    Frequent keys go where their least document sends them: those of one group of similar sets then meet in few buckets, which find a pair once instead of once in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        total = 0

        def rows() -> pa.RecordBatch:
            key = np.concatenate([k for _, k in held])
            many = [len(k) for _, k in held]
            doc = np.repeat(np.array([d for d, _ in held], np.int64), many)
            size = np.repeat(np.array(sizes, np.int32), many)
            pos = (np.arange(len(key)) - np.repeat(np.cumsum([0, *many[:-1]]), many)).astype(np.int32)
            mixed = flat.mix(key)
            bucket = frequent.buckets(key, mixed, buckets)
            order = np.argsort(bucket, kind="stable")
            ids, cut = np.unique(bucket[order], return_index=True)
            blobs = []
            for part in np.split(order, cut[1:]):
                blobs.append(packed([(mixed[part] >> np.uint64(32)).astype(np.uint32), np.diff(doc[part], prepend=0), size[part], pos[part]]))
            return pa.record_batch([pa.array(ids), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        sizes: list[int] = []
        for batch in flat.chunks(batches, most=CHUNK):
            for doc, s in zip(batch.column("doc_id").to_pylist(), keys_of(batch, n, frequent)):
                if len(s):
                    held.append((doc, s[: prefix(len(s), t)]))
                    sizes.append(len(s))
                    total += len(held[-1][1])
            if total > HELD:
                yield rows()
                held, sizes, total = [], [], 0
        if held:
            yield rows()

    return run


def ordered_lists(key: np.ndarray, doc: np.ndarray, size: np.ndarray, pos: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """(doc, size, pos, far) of entries by list, size and position; an entry's partners stand behind it, up to ``far``, where sizes become too large."""
    order = np.lexsort((doc, pos, size, key))
    key, doc, size, pos = key[order], doc[order], size[order], pos[order]
    place = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 32
    far = np.searchsorted(place | size, place | np.floor(size / t + 1e-9).astype(np.int64), "right")
    return doc, size, pos, far


def passes(doc: np.ndarray, many: np.ndarray, documents: int) -> Iterator[np.ndarray]:
    """Entries of whole documents, as many as can have PAIRS distinct partners together."""
    most = np.minimum(np.bincount(doc, many, documents), documents)
    part = (np.cumsum(most) // PAIRS).astype(np.int64)[doc]
    order = np.argsort(part, kind="stable")
    yield from (np.sort(x) for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1))


def list_pairs(doc: np.ndarray, size: np.ndarray, pos: np.ndarray, far: np.ndarray, chosen: np.ndarray, t: float, tested: list[int] | None = None) -> Iterator[tuple]:
    """Pairs of the chosen entries with those behind them that sizes and positions allow, in bounded slabs: (doc, doc, early).

    At most min(pos) elements can be common before a common one and min(size - pos) from it on; ``early``
    pairs have enough of the latter alone, as the first common element of a similar pair must. tested: gets how many entries were in reach,
    and how many were looked at."""
    rest, heads = size - pos, np.arange(0, len(doc), SKIP)
    most_rest, most_pos, least_size = np.maximum.reduceat(rest, heads), np.maximum.reduceat(pos, heads), np.minimum.reduceat(size, heads)
    first = (chosen + 1) // SKIP
    edge = np.concatenate([[0], np.cumsum(np.where(far[chosen] > chosen + 1, (far[chosen] - 1) // SKIP - first + 1, 0))])
    for c in range(0, int(edge[-1]), SLAB):
        at = np.arange(c, min(int(edge[-1]), c + SLAB))
        k = np.searchsorted(edge, at, "right") - 1
        i, block = chosen[k], first[k] + at - edge[k]
        need = least_overlap(size[i], np.maximum(least_size[block], size[i]), t)
        open_ = np.flatnonzero(np.minimum(rest[i], most_rest[block]) + np.minimum(pos[i], most_pos[block]) >= need)
        i, low = i[open_], np.maximum(block[open_] * SKIP, i[open_] + 1)
        many = np.minimum((block[open_] + 1) * SKIP, far[i]) - low
        if tested is not None:
            tested[0] += int((np.minimum((block + 1) * SKIP, far[chosen[k]]) - np.maximum(block * SKIP, chosen[k] + 1)).sum())
            tested[1] += int(many.sum())
        for part in range(0, len(i), SLAB // SKIP):
            own = slice(part, part + SLAB // SKIP)
            x = np.repeat(i[own], many[own])
            y = np.arange(len(x)) - np.repeat(np.cumsum(many[own]) - many[own], many[own]) + np.repeat(low[own], many[own])
            need, left = least_overlap(size[x], size[y], t), np.minimum(rest[x], rest[y])
            fits = (left + np.minimum(pos[x], pos[y]) >= need) & (doc[x] != doc[y])
            x, y, early = x[fits], y[fits], (left >= need)[fits]
            if len(x):
                yield np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), early


def _candidates(t: float):
    """Rows (a, b, shared, sizes): prefix elements of this partition's keys in both sets, and how many of them are early (the high half); sizes of a (the high half) and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for blob in batch.column("blob"):
                key, step, size, pos = unpacked(memoryview(blob.as_buffer()), ENTRY)
                for part, x in zip(parts, (key, np.cumsum(step), size, pos)):
                    part.append(x)
        if not parts[0]:
            return
        key, doc, size, pos = (np.concatenate(p) for p in parts)
        parts.clear()
        ids, doc = np.unique(doc, return_inverse=True)
        doc = doc.astype(np.int32)
        sizes = np.zeros(len(ids), np.int64)
        sizes[doc] = size
        doc, size, pos, far = ordered_lists(key, doc, size, pos, t)
        del key

        def merged(known, count, fresh, ones):
            codes, inverse = np.unique(np.concatenate([known, *fresh]), return_inverse=True)
            return codes, np.bincount(inverse, np.concatenate([count, *ones]), len(codes)).astype(np.int64)

        for chosen in passes(doc, np.maximum(far - np.arange(1, len(far) + 1), 0), len(ids)):
            known, count, fresh, ones, waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], [], 0
            for a, b, early in list_pairs(doc, size, pos, far, chosen, t):
                fresh.append(a.astype(np.int64) * len(ids) + b)
                ones.append(1 + (early.astype(np.int64) << 24))
                waiting += len(a)
                if waiting > max(2 * SLAB, len(known) // 2):
                    known, count = merged(known, count, fresh, ones)
                    fresh, ones, waiting = [], [], 0
            known, count = merged(known, count, fresh, ones)
            for k in range(0, len(known), 200_000):
                a, b = np.divmod(known[k : k + 200_000], len(ids))
                n = count[k : k + 200_000]
                low = ids[a] < ids[b]
                first, second = np.where(low, a, b), np.where(low, b, a)
                yield pa.record_batch([pa.array(ids[first]), pa.array(ids[second]), pa.array((n & 0xFFFFFF) | n >> 24 << 32), pa.array(sizes[first] << 32 | sizes[second])], names=["a", "b", "shared", "sizes"])
        del doc, size, pos, far
        flat.release()

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.chunks(batches, most=CHUNK):
            sets = keys_of(batch, n, NO_FREQUENT)
            some = pa.array([k for k, s in enumerate(sets) if len(s)], pa.int64())
            yield pa.record_batch([batch.column("doc_id").take(some), pa.array([s.tobytes() for s in sets if len(s)], pa.binary())], names=["doc_id", "keys"])

    return run


def overlaps(sets: dict[int, np.ndarray], pairs: list[tuple[int, int]]) -> list[int]:
    """|x ∩ z| for each pair (x, z), derived along chains of similar sets where that is less work."""
    docs = list(sets)
    leader: dict[int, int] = {}
    for x, z in pairs:
        leader[z] = min(leader.get(z, z), x)
        leader.setdefault(x, x)
    chain = sorted(docs, key=lambda d: (leader.get(d, d), d))
    place = {d: k for k, d in enumerate(chain)}
    _, dense = np.unique(np.concatenate([sets[d] for d in chain]), return_inverse=True)
    own = np.split(dense, np.cumsum([len(sets[d]) for d in chain])[:-1])
    add, drop, segment = [], [], []
    for k, d in enumerate(chain):
        if k and leader.get(d, d) == leader.get(chain[k - 1], chain[k - 1]):
            plus, minus = np.setdiff1d(own[k], own[k - 1], True), np.setdiff1d(own[k - 1], own[k], True)
            segment.append(segment[-1])
        else:
            plus, minus = own[k], own[k][:0]
            segment.append(k)
        add.append(plus)
        drop.append(minus)
    steps = np.concatenate([np.concatenate(x) for x in zip(add, drop)])
    cost = np.cumsum([0, *(len(p) + len(m) for p, m in zip(add, drop))])
    cuts = np.cumsum([0, *(n for p, m in zip(add, drop) for n in (len(p), len(m)))])
    marked = np.zeros(int(dense.max(initial=-1)) + 1, np.int8)
    by: dict[int, list[tuple[int, int]]] = {}
    for k, (x, z) in enumerate(pairs):
        by.setdefault(z, []).append((place[x], k))
    out = [0] * len(pairs)
    for z, asked in by.items():
        mine = own[place[z]]
        marked[mine] = 1
        asked.sort()
        k = 0
        while k < len(asked):
            s, e = segment[asked[k][0]], k
            while e < len(asked) and segment[asked[e][0]] == s:
                e += 1
            last = asked[e - 1][0]
            if sum(len(own[p]) for p, _ in asked[k:e]) <= cost[last + 1] - cost[s]:
                for p, q in asked[k:e]:
                    out[q] = int(marked[own[p]].sum())
            else:
                total = np.concatenate([[0], np.cumsum(marked[steps[cost[s] : cost[last + 1]]], dtype=np.int64)])
                c = cuts[2 * s : 2 * last + 3] - cuts[2 * s]
                each = np.diff(total[c])
                so_far = np.cumsum(each[::2] - each[1::2])
                for p, q in asked[k:e]:
                    out[q] = int(so_far[p - s])
            k = e
        marked[mine] = 0
    return out


def _check(t: float):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        own = {d: np.frombuffer(k.as_buffer(), np.uint64) for d, k in zip(sets.column("doc_id").to_pylist(), sets.column("keys"))}
        common = np.array(overlaps(own, list(zip(a, b))) if a else [], np.int64)
        sizes = np.array([len(own[d]) for d in a], np.int64) + np.array([len(own[d]) for d in b], np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaccard = common / (sizes - common)
        keep = np.flatnonzero(jaccard >= t - 1e-12)
        return pa.table({"doc_a": pa.array(np.array(a, np.int64)[keep]), "doc_b": pa.array(np.array(b, np.int64)[keep]), "jaccard": pa.array(np.round(jaccard[keep], 6))})

    return run


def separated(docs: DataFrame, own: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(docs, own, names) where each id has one set: the texts of a doc_id with several sets go under hashes that are no doc_id, and names has their doc_id."""
    several = written(own.groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-several")
    if not several.limit(1).count():
        return docs, own, None
    texts, rest = docs.join(small(several), "doc_id", "left_semi").distinct(), docs.join(small(several), "doc_id", "left_anti")
    for salt in count():
        apart = written(texts.select(F.xxhash64(F.lit(salt), "doc_id", "text").alias("id"), "doc_id", "text"), "near-apart")
        taken = apart.select("id").union(own.select("doc_id").distinct()).groupBy("id").count()
        if not taken.where("count > 1").limit(1).count():
            break
    texts = apart.select(F.col("id").alias("doc_id"), "text")
    sets = texts.mapInArrow(_survey(n), SURVEY).where("key is null and size > 0").select("doc_id", "sig")
    return rest.union(texts), own.join(small(several), "doc_id", "left_anti").union(sets), apart.select("id", F.col("doc_id").alias("name"))


def set_join(docs: DataFrame, t: float = THRESHOLD, n: int = N) -> tuple[DataFrame, DataFrame, bool]:
    """(members, pairs, several): each document with the representative of each of its sets; similar representatives; whether a document has several sets.

    A representative is the least doc_id with its set, or stands for a text of a doc_id with several sets."""
    spark = docs.sparkSession
    tune(spark)
    whole_ids(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).where("doc_id is not null and text is not null")
    survey = written(docs.mapInArrow(_survey(n), SURVEY), "near-survey")
    heavy = survey.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(FREQUENT_KEYS).toArrow()
    frequent = Frequent(np.asarray(heavy["key"]).astype(np.int64).view(np.uint64), np.asarray(heavy["n"]), np.asarray(heavy["low"]))
    own = survey.where("key is null and size > 0").select("doc_id", "sig").distinct()
    docs, own, names = separated(docs, own, n)
    members = written(own.join(own.groupBy("sig").agg(F.min("doc_id").alias("rep")), "sig").select("doc_id", "rep"), "near-members")
    # a document is left out of the join if its set is that of another
    others = written(members.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("rep")).cast("int")).alias("is_rep")).where("is_rep = 0").select("doc_id"), "near-others")
    reps = docs.join(small(others), "doc_id", "left_anti")
    posted = reps.mapInArrow(_postings(n, t, frequent, 8 * parts), "bucket int, blob binary")
    found = posted.repartition(parts, "bucket").mapInArrow(_candidates(t), "a long, b long, shared long, sizes long")
    # what is common beyond the common prefix elements lies behind the prefix that ends first, which may be the larger set's
    low, high = (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftright(c, 32))
    enough = low("shared") + F.ceil(F.lit(t) * F.greatest(low("sizes"), high("sizes")) - 1e-9) - 1 >= F.ceil(F.lit(t / (1 + t)) * (low("sizes") + high("sizes")) - 1e-9)
    candidates = written(found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("sizes").alias("sizes")).where(enough & (high("shared") > 0)).select("a", "b"), "near-candidates")
    wanted = written(candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).distinct(), "near-wanted")
    sets = reps.join(small(wanted), "doc_id", "left_semi").mapInArrow(_sets(n), "doc_id long, keys binary")
    # pairs of one group of similar sets are checked together, in blocks of bounded size
    step = candidates.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("low"))
    ends = candidates.select(F.col("a").alias("doc")).union(candidates.select("b")).distinct()
    label = ends.join(step, "doc", "left").select("doc", F.coalesce("low", "doc").alias("low"))
    label = label.join(label.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("sides")), "low")
    label = written(label.select("doc", "low", F.pmod(F.xxhash64("doc"), F.col("sides")).alias("side")), "near-labels")
    la, lb = (label.select(F.col("doc").alias(x), F.col("low").alias(f"low_{x}"), F.col("side").alias(f"side_{x}")) for x in "ab")
    same = F.col("low_a") == F.col("low_b")
    inside = F.xxhash64("low_a", F.least("side_a", "side_b"), F.greatest("side_a", "side_b"))
    across = F.xxhash64("low_a", "low_b", "side_a", "side_b")
    blocked = written(candidates.join(la, "a").join(lb, "b").select(F.when(same, inside).otherwise(across).alias("block"), "a", "b"), "near-blocks")
    needed = blocked.select(F.col("block").alias("at"), F.col("a").alias("doc_id")).union(blocked.select("block", "b")).distinct()
    placed = needed.join(sets, "doc_id")
    pairs = blocked.groupBy("block").cogroup(placed.groupBy("at")).applyInArrow(_check(t), "doc_a long, doc_b long, jaccard double")
    if names is not None:
        members = written(members.join(names, members["doc_id"] == names["id"], "left").select(F.coalesce("name", "doc_id").alias("doc_id"), "rep").distinct(), "near-members")
    return members, written(pairs, "near-pairs"), names is not None


def linked(docs: DataFrame, t: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that is similar to another one.

    Similar pairs connect texts to classes; class_id is the least doc_id of the class. n_links counts the texts of other
    documents that are similar or equal to the document's text, copies too, without making pairs of copies. A doc_id with several texts has
    a row for each class that they are in."""
    members, pairs, several = set_join(docs, t, n)
    size = written(members.groupBy("rep").agg(F.count(F.lit(1)).alias("size")), "near-sizes")
    both = pairs.select(F.col("doc_a").alias("rep"), F.col("doc_b").alias("other")).union(pairs.select("doc_b", "doc_a"))
    partners = both.join(size.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("size").alias("partners"))
    roots = components(pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))).withColumnRenamed("node", "rep")
    sets = size.join(partners, "rep", "left").join(roots, "rep", "left").select("rep", F.coalesce("root", "rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")).where("n_links > 0")
    out = members.join(sets, "rep")
    if several:
        # a document's own texts aren't its partners, and representatives may be texts
        least = out.groupBy("class_id").agg(F.min("doc_id").alias("least"))
        many = members.join(small(written(members.groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-many")), "doc_id", "left_semi")
        own = both.join(many, "rep").join(many.select(F.col("doc_id").alias("same"), F.col("rep").alias("other")), "other").where("doc_id = same").groupBy("doc_id", "rep").agg(F.count(F.lit(1)).alias("own"))
        out = out.join(own, ["doc_id", "rep"], "left").join(least, "class_id").groupBy("doc_id", F.col("least").alias("class_id")).agg(F.sum(F.col("n_links") - F.coalesce("own", F.lit(0))).alias("n_links")).where("n_links > 0")
    return out.select("doc_id", "class_id", "n_links")


def jaccard_join(docs: DataFrame, t: float = THRESHOLD, n: int = N) -> DataFrame:
    """All pairs (doc_a, doc_b, jaccard) of Jaccard t or more; equal sets take over their representative's answers."""
    members, pairs, several = set_join(docs, t, n)
    a, b = members.select(F.col("doc_id").alias("x"), F.col("rep").alias("doc_a")), members.select(F.col("doc_id").alias("y"), F.col("rep").alias("doc_b"))
    near = pairs.join(a, "doc_a").join(b, "doc_b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    equal = members.alias("l").join(members.alias("r"), F.expr("l.rep = r.rep and l.doc_id < r.doc_id")).select(F.col("l.doc_id").alias("doc_a"), F.col("r.doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    out = near.where("doc_a < doc_b").union(equal)
    return out.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard")) if several else out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that edges (a, b) lead to, by minimum propagation with pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        near = labels.join(seen, "node").select("node", "root", F.least("root", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("beyond"))
        moved = written(near.join(jump, "next").select("node", F.least("next", "beyond").alias("root"), (F.least("next", "beyond") < F.col("root")).alias("moved")), "labels")
        labels = moved.select("node", "root")
        if not moved.where("moved").limit(1).count():
            return labels


def drop_near_duplicates(docs: DataFrame, t: float = THRESHOLD, n: int = N) -> DataFrame:
    """The documents without all but the least doc_id of each group that similar pairs connect.

    Texts connect groups, not identifiers: a doc_id with several texts goes with all its rows unless it is
    the least of each group that they are in. Rows in no group stay as they are, null texts and null doc_ids among them."""
    members, pairs, _ = set_join(docs, t, n)
    roots = components(pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    grouped = written(members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root")), "near-grouped")
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("least"))
    (gone_id,) = free(docs.columns, "__gone")
    gone = grouped.join(least, "root").where("doc_id <> least").select(F.col("doc_id").alias(gone_id)).distinct()
    gone = small(written(gone, "near-gone"))
    return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
