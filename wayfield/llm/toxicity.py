"""Operator 4: toxicity by a factorization machine over hashed terms.

Terms are a document's distinct lower-cased words and their first four and five bytes, hashed to BITS bits.
    logit = b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)
so that pairs of terms count beyond what each adds (an insult with a mention of a group, say). Terms have weights and
factors if their presence tells something about the labels, by itself (the TERMS terms of largest chi-square, LEAST_CHI or more) or
only together with another term (:func:`interacting`); terms of neither kind have none. Fitted on at most SAMPLE labelled documents,
the least by hash of doc_id; everything is scored, over whole texts.

Defined results: null, empty and wordless texts have no term, and only the bias counts; labels that are null,
repeated (the greatest counts) or of unknown documents are dropped; with labels of one kind only there is
no model, no probability and no toxic document; null doc_ids, repeated rows and further columns stay as they are;
if a column is called __toxic, the probability takes the next free name (__toxic_).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .shared import free, tune

BITS, TERMS, SAMPLE, FACTORS, TOXIC = 18, 4096, 8000, 4, 0.2
ROUNDS, RATE, RIDGE, LEAST_DOCS, LEAST_CHI = 200, 0.08, 1e-4, 4, 15.0
#: Terms whose pairs are looked at, those that are neither rare nor everywhere first, and the square of the z-score that an interaction needs among so many.
PAIRED, LEAST_Z2 = 1024, 40.0


@dataclass(frozen=True)
class Machine:
    """place: weight row of each hashed term, -1 for none."""

    place: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """term: weight rows of the terms that are present, row: their documents."""
        out = self.bias + np.bincount(row, self.w[term], rows)
        for f in range(self.v.shape[1]):
            own = self.v[term, f]
            out += 0.5 * (np.bincount(row, own, rows) ** 2 - np.bincount(row, own * own, rows))
        return out


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed term) of every word and its beginnings, with repeats."""
    starts, ends, first = flat.words(data, offsets)
    total = flat.prefix_hash(data)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    parts = [flat.span_hash(total, starts, ends)]
    docs = [doc]
    for n in (4, 5):
        long = np.flatnonzero(ends - starts > n)
        parts.append(flat.mix(flat.span_hash(total, starts[long], starts[long] + n) + np.uint64(n)))
        docs.append(doc[long])
    return np.concatenate(docs), (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in flat.chunks(batches):
        doc, term = terms(*flat.flat(batch.column("text")))
        both = np.unique(doc << BITS | term)
        cut = np.searchsorted(both >> BITS, np.arange(batch.num_rows + 1))
        rows = [(both[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "terms"])


def interacting(y: np.ndarray, row: np.ndarray, term: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Terms that change what another term says about the labels, even if neither says anything by itself.

    For terms i and j: the difference that j makes to the rate of 1s where i is, against that where i isn't."""
    n = len(y)
    balance = np.minimum(seen, n - seen)
    chosen = np.sort(np.argsort(-balance, kind="stable")[:PAIRED])
    chosen = chosen[balance[chosen] >= LEAST_DOCS]
    if len(chosen) < 2:
        return chosen[:0]
    at = np.minimum(np.searchsorted(chosen, term), len(chosen) - 1)
    own = chosen[at] == term
    x = np.zeros((n, len(chosen)), np.float32)
    x[row[own], at[own]] = 1
    both, both_bad = (x.T @ x).astype(np.float64), (x.T @ (x * y[:, None].astype(np.float32))).astype(np.float64)
    one, one_bad = np.diag(both), np.diag(both_bad)
    counts = (both, one[:, None] - both, one[None, :] - both, n - one[:, None] - one[None, :] + both)
    bads = (both_bad, one_bad[:, None] - both_bad, one_bad[None, :] - both_bad, y.sum() - one_bad[:, None] - one_bad[None, :] + both_bad)
    rates = [(b + 0.5) / (c + 1) for b, c in zip(bads, counts)]
    change = rates[0] - rates[1] - rates[2] + rates[3]
    variance = sum(p * (1 - p) / (c + 1) for p, c in zip(rates, counts))
    few = np.minimum.reduce(counts) < LEAST_DOCS
    z2 = np.where(few, 0, change**2 / variance)
    np.fill_diagonal(z2, 0)
    return chosen[z2.max(axis=0) >= LEAST_Z2]


def loss_and_slopes(theta: np.ndarray, k: int, y: np.ndarray, row: np.ndarray, term: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss and its slopes; theta: bias, m weights, k times m factors."""
    n, m = len(y), (len(theta) - 1) // (k + 1)
    w, v = theta[1 : m + 1], theta[m + 1 :].reshape(k, m)
    own = v[:, term]
    sums = np.stack([np.bincount(row, own[f], n) for f in range(k)])
    logit = theta[0] + np.bincount(row, w[term], n) + 0.5 * sum(sums[f] ** 2 - np.bincount(row, own[f] ** 2, n) for f in range(k))
    slope = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / n
    each = slope[row]
    g = np.concatenate([[slope.sum()], np.bincount(term, each, m), *(np.bincount(term, each * (sums[f][row] - own[f]), m) for f in range(k))])
    return float(np.mean(np.logaddexp(0, logit) - y * logit)), g


def fit_arrays(rows: list[tuple[int, np.ndarray]], seed: int = 3) -> Machine | None:
    """rows: (label, distinct hashed terms). Full-batch Adam on the logistic loss."""
    y = np.array([r[0] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r[1]) for r in rows])
    term = np.concatenate([r[1] for r in rows])
    seen, bad = np.bincount(term, minlength=1 << BITS), np.bincount(term, y[row], 1 << BITS)
    pos = y.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (bad * n - seen * pos) ** 2 / (pos * (n - pos) * seen * (n - seen))
    chi[(seen < LEAST_DOCS) | ~np.isfinite(chi)] = 0
    chosen = np.argsort(-chi, kind="stable")[:TERMS]
    chosen = np.union1d(chosen[chi[chosen] >= LEAST_CHI], interacting(y, row, term, seen))
    place = np.full(1 << BITS, -1, np.int16)
    place[chosen] = np.arange(len(chosen))
    term = place[term].astype(np.int64)
    row, term = row[term >= 0], term[term >= 0]
    m, k = len(chosen), FACTORS
    rate = pos / n
    theta = np.concatenate([[np.log(rate / (1 - rate))], np.zeros(m), np.random.default_rng(seed).normal(0, 0.05, m * k)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        _, g = loss_and_slopes(theta, k, y, row, term)
        g[1:] += RIDGE * theta[1:]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(place, float(theta[0]), theta[1 : m + 1].copy(), theta[m + 1 :].reshape(k, m).T.copy())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    rated = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.mapInArrow(_present, "doc_id long, toxic int, terms binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.terms))
    return fit_arrays([(min(r.toxic, 1), np.frombuffer(r.terms, np.int32)) for r in rows])


def score_batch(model: Machine, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each document."""
    doc, term = terms(data, offsets)
    term = model.place[term].astype(np.int64)
    known = np.flatnonzero(term >= 0)
    both = np.unique(doc[known] << 16 | term[known])
    logit = model.logits(both >> 16, both & 0xFFFF, len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def score(docs: DataFrame, model: Machine | None) -> DataFrame:
    """All columns of docs with the probability ``__toxic`` (null without a model)."""
    lower, own_name = free(docs.columns, "__lower", "__toxic")
    if model is None:
        return docs.withColumn(own_name, F.lit(None).cast("double"))
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.chunks(batches, lower):
            own = pa.array(score_batch(model, *flat.flat(batch.column(lower))))
            yield pa.record_batch([*batch.columns[:-1], own], names=[*batch.schema.names[:-1], own_name])

    return docs.withColumn(lower, F.lower("text")).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own_name, T.DoubleType())]))


def toxic(docs: DataFrame, model: Machine | None, least: float = TOXIC) -> DataFrame:
    """The scored documents whose probability reaches ``least``."""
    return score(docs, model).where(F.col(free(docs.columns, "__toxic")[0]) >= least)
