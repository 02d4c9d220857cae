"""Operator 10: ordinal cumulative-link regression on graded ratings over hashed text.

Grades: 0 for labels with quality 0, 1 for quality 1 with toxic 1, 2 for quality 1 otherwise. With the
shared weights w of hashed features x and ordered thresholds, P(grade <= k) = sigmoid(theta_k - w.x).
Features are the byte trigrams of the raw text (their mean weight counts) and buckets of a document's
share of distinct words, of capitals, of signs, and of its length. A document is selected if its tail
probability P(grade >= 1) reaches SELECT.

The model is fitted on at most SAMPLE labelled documents, the least by hash of doc_id; everything is scored.
Defined results: a null text counts as empty; an empty text has only its bucket features; labels that
are null, repeated (the greatest grade counts) or of unknown documents are dropped; with fewer than two
grades in the sample there is no model: every probability and grade is null and every row is selected.
Null doc_ids, repeated rows and further columns stay as they are; if a column is called __rating, the struct takes the next free
name (__rating_).
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

BITS, SAMPLE, SELECT, GRADES = 16, 5000, 0.5, 3
ROUNDS, RATE, RIDGE, SCALE = 250, 0.15, 2e-4, 12.0
#: Words whose hashes stand for the buckets of the document's own measures, after the trigrams.
BUCKETS = 4 * 16


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) by row."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all documents, and where each document's begin."""
    if len(data) < 3:
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    code = data[:-2].astype(np.uint32) << 16
    code |= data[1:-1].astype(np.uint32) << 8
    code |= data[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - BITS)
    keep = np.ones(len(code), bool)
    for k in (1, 2):  # those that reach into the next document
        cut = offsets[1:] - k
        keep[cut[(cut >= 0) & (cut < len(code))]] = False
    count = np.maximum(np.diff(offsets) - 2, 0)
    return code[keep], np.concatenate([[0], np.cumsum(count)])


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Four feature numbers of each document: buckets of distinct words, capitals, signs and length."""
    starts, ends, first = flat.words(data, offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    own = np.sort((doc << np.uint64(40)) | (flat.word_hash(data, starts, ends) >> np.uint64(24)))
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    distinct = flat.sums(new, first)
    n = np.diff(offsets)
    capital = flat.sums((data >= 65) & (data <= 90), offsets)
    sign = flat.sums((data > 32) & (data < 48) | (data > 90) & (data < 97) | (data > 122) & (data < 127) | (data > 57) & (data < 65), offsets)
    # with more words fewer are new: what is expected of n words is about n^0.8
    share = distinct / np.maximum(count, 1) ** 0.8
    parts = [np.minimum(share * 10, 15), np.minimum(capital / np.maximum(n, 1) * 30, 15), np.minimum(sign / np.maximum(n, 1) * 40, 15), np.minimum(np.log2(n + 1), 15)]
    return np.stack([p.astype(np.int64) + (1 << BITS) + 16 * k for k, p in enumerate(parts)], axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in flat.chunks(batches):
        data, offsets = flat.flat(batch.column("text"))
        code, at = trigrams(data, offsets)
        own = measures(data, offsets)
        index, value = [], []
        for k in range(batch.num_rows):
            ids, times = np.unique(code[at[k] : at[k + 1]], return_counts=True)
            index.append(np.concatenate([ids, own[k]]).astype(np.int32).tobytes())
            value.append(np.concatenate([times * (SCALE / max(1, times.sum())), np.ones(4)]).astype(np.float32).tobytes())
        yield pa.record_batch([batch.column("doc_id"), batch.column("grade"), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "grade", "feature", "value"])


def loss_and_slopes(y: np.ndarray, score: np.ndarray, shape: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of grades, its slope by each score, and by the free form of the thresholds (theta_0, then log gaps)."""
    grades = len(shape) + 1
    theta = np.concatenate([shape[:1], shape[0] + np.cumsum(np.exp(shape[1:]))])
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    hi, lo = (1 / (1 + np.exp(-np.clip(edge[y + d] - score, -40, 40))) for d in (1, 0))
    p = np.maximum(hi - lo, 1e-12)
    up, down = hi * (1 - hi) / p, lo * (1 - lo) / p
    by_edge = np.zeros(grades + 1)
    np.add.at(by_edge, y + 1, -up / len(y))
    np.add.at(by_edge, y, down / len(y))
    tail = np.cumsum(by_edge[1:-1][::-1])[::-1]
    return float(-np.log(p).mean()), (up - down) / len(y), np.concatenate([tail[:1], tail[1:] * np.exp(shape[1:])])


def fit_arrays(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int = GRADES) -> Model | None:
    """Full-batch Adam on the log-likelihood; rows are (grade, feature numbers, values)."""
    y = np.array([r[0] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    at = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
    index, value = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), np.diff(at))
    size = (1 << BITS) + BUCKETS
    w = np.zeros(size)
    base = np.cumsum([max(1, (y == k).sum()) for k in range(grades - 1)]) / (len(y) + grades)
    first = np.log(base / (1 - base))
    # theta_0, then log gaps: the thresholds stay ordered
    thresholds = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    m, v = np.zeros(size + len(thresholds)), np.zeros(size + len(thresholds))
    for step in range(1, ROUNDS + 1):
        score = np.bincount(row, value * w[index], len(rows))
        _, slope, by_threshold = loss_and_slopes(y, score, thresholds)
        g = np.concatenate([np.bincount(index, value * slope[row], size) + RIDGE * w, by_threshold])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:size]
        thresholds = thresholds - move[size:]
    return Model(w.astype(np.float32), np.concatenate([thresholds[:1], thresholds[0] + np.cumsum(np.exp(thresholds[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of at most ``sample`` labelled documents."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_features, "doc_id long, grade int, feature binary, value binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.feature))
    return fit_arrays([(r.grade, np.frombuffer(r.feature, np.int32), np.frombuffer(r.value, np.float32)) for r in rows])


def score_batch(model: Model, texts: pa.Array) -> np.ndarray:
    data, offsets = flat.flat(texts)
    code, at = trigrams(data, offsets)
    return SCALE * flat.sums(model.weights[code], at) / np.maximum(np.diff(at), 1) + model.weights[measures(data, offsets)].sum(axis=1)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with struct ``__rating`` of expected_grade and tail probability p_good (both null without a model)."""
    (own_name,) = free(docs.columns, "__rating")
    if model is None:
        return docs.withColumn(own_name, F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_good")))
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.chunks(batches):
            p = model.probabilities(score_batch(model, batch.column("text")))
            own = pa.StructArray.from_arrays([pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, 1:].sum(axis=1))], names=["expected_grade", "p_good"])
            yield pa.record_batch([*batch.columns, own], names=[*batch.schema.names, own_name])

    rating = T.StructType().add("expected_grade", "double").add("p_good", "double")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own_name, rating)]))


def selected(docs: DataFrame, model: Model | None) -> DataFrame:
    """The scored documents that the classifier keeps."""
    (own,) = free(docs.columns, "__rating")
    good = F.col(f"{own}.p_good")
    return score(docs, model).where(good.isNull() | (good >= SELECT))
