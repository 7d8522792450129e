"""Operator 9: quality classifier, naive Bayes support vectors.

Features are indicators of n-grams, hashed to 2**BITS buckets: runs of three bytes of the text as it is, pairs of neighbouring lower-cased
words, and n-grams of repetition (the last word again; the word two, three, ... back again; the share of distinct words in eighths).
Each indicator is scaled by its log-count ratio between the classes, rows are scaled to unit length over their indicators, and a linear
model with hinge loss is fitted to them by dual coordinate descent. The score is the logistic function of the margin, so that 0.5 is the
model's border; a row is rejected below it.

Fitting takes a bounded sample: at most SAMPLE_ROWS labelled rows of each class, those with the smallest digest of their id, and SAMPLE_INDICATORS indicators. Fitting
runs in one task, which gets no more than that; the driver holds the model only. Every document is scored, whole, in one pass over the table without a shuffle.

Null or empty text: no indicators, so the score of the bias. Null labels are no labels. Rows with a repeated or null doc_id are all scored; a null one has no labels. If one
class has no labelled row, every score is that of the other class (1 or 0; 0.5 without labels). Extra columns are ignored by `scores`, and kept by `kept`.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower, pick, shared_folder, small_batches, span_hashes, steps, utf8, word_spans, written

BITS = 18
#: The bound of the sample that the model is fitted to, for each class.
SAMPLE_ROWS = 4000
#: The bound of the sample's indicators, four bytes each, half for each class; later rows wait outside.
SAMPLE_INDICATORS = 16_000_000
EPOCHS, PENALTY, SMOOTHING = 12, 1.0, 1.0
#: Rows of the rarer class weigh so much more in the loss at most.
MOST_WEIGHT = 2.0
BACK = (1, 2, 3, 4, 8)


def indicators(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of each document, in no order."""
    size = 1 << BITS
    last = np.zeros(size, np.int64)
    for i, j in steps(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        three = part[:-2].astype(np.uint32) | part[1:-1].astype(np.uint32) << 8 | part[2:].astype(np.uint32) << 16
        three = (three * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)
        low = lower(part)
        starts, ends, words = word_spans(low, at)
        h = span_hashes(low, starts, ends)
        pairs = ((h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)
        again = [h[b:] == h[:-b] if len(h) > b else np.zeros(0, bool) for b in BACK]
        for d in range(j - i):
            w0, w1 = words[d], words[d + 1]
            marks = [size - 1 - k for k, b in enumerate(BACK) if w1 - w0 > b and 2 * np.count_nonzero(again[k][w0 : w1 - b]) > w1 - w0 - b]
            marks += [size - 11 - k for k, b in enumerate(BACK) if w1 - w0 > b and 20 * np.count_nonzero(again[k][w0 : w1 - b]) > w1 - w0 - b]
            if w1 - w0 >= 8:
                marks.append(size - 31 - 8 * len(np.unique(h[w0:w1])) // (w1 - w0))
            all_ = np.concatenate([three[at[d] : max(at[d], at[d + 1] - 2)], pairs[w0 : max(w0, w1 - 1)], np.array(marks, np.int64)])
            place = np.arange(len(all_))
            last[all_] = place
            yield all_[last[all_] == place]


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: ratio times weight
    bias: float

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.array([self.weights[x].sum() / max(1.0, np.sqrt(len(x))) + self.bias for x in indicators(raw, offsets)])


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, penalty: float = PENALTY) -> Model:
    """rows: the distinct buckets of each row; labels: 1 or 0."""
    size = 1 << BITS
    y = np.where(labels == 1, 1.0, -1.0)
    if not len(rows) or len(np.unique(y)) < 2:
        return Model(np.zeros(size), 1e3 * float(y[0]) if len(rows) else 0.0)
    count = np.full((2, size), SMOOTHING)
    for x, up in zip(rows, y > 0, strict=True):
        count[int(up), x] += 1
    n = np.array([(y < 0).sum(), (y > 0).sum()])
    ratio = np.log(count[1] / (n[1] + 2 * SMOOTHING)) - np.log(count[0] / (n[0] + 2 * SMOOTHING))
    ratio[(count.sum(0) - 2 * SMOOTHING) < 2] = 0  # seen once: no evidence
    upper = penalty * np.where(y > 0, np.minimum(MOST_WEIGHT, max(1, n[0] / n[1])), np.minimum(MOST_WEIGHT, max(1, n[1] / n[0])))
    scale = np.array([1 / max(1.0, np.sqrt(len(x))) for x in rows])
    norm = np.array([np.square(ratio[x]).sum() for x in rows]) * scale**2 + 1
    w, b, alpha, order = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            v = ratio[x] * scale[i]  # again each time: kept for all rows they would take twice the sample's size
            g = y[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                b += step
                alpha[i] = new
    return Model(w * ratio, b)


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, label; null ids or other labels are none): fits a model to a bounded sample of the rows with a label."""
    labels = labels.filter("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64(F.col("doc_id").cast("string")).alias("digest"))
    some = [labels.filter(F.col("label") == c).orderBy("digest", "doc_id").limit(sample_rows) for c in (0, 1)]
    sample = docs.join(F.broadcast(some[0].union(some[1]).select("doc_id", "label", "digest")), "doc_id")  # bounded by sample_rows

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            found = [x.astype("<u4").tobytes() for x in indicators(*utf8(b.column(3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "digest", "buckets"])

    table = written(sample.select("doc_id", "label", "digest", "text").mapInArrow(featured, "doc_id long, label int, digest long, buckets binary"), shared_folder(docs.sparkSession), "sample")
    fitted = table.repartition(1).sortWithinPartitions("digest", "doc_id", "label").mapInArrow(_fitted, "weights binary, bias double").first()
    return Model(np.frombuffer(fitted.weights, np.float64), fitted.bias) if fitted else fit([], np.zeros(0))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model, fitted to the rows that the bound of indicators leaves."""
    rows: list[np.ndarray] = []
    labels: list[int] = []
    room = [2 * SAMPLE_INDICATORS] * 2  # bytes of each class
    for b in batches:
        for label, x in zip(b.column(1).to_pylist(), b.column(3), strict=True):
            room[label] -= len(x.as_buffer())
            if room[label] >= 0:
                rows.append(np.frombuffer(x.as_buffer(), "<u4").copy())
                labels.append(label)
    model = fit(rows, np.array(labels))
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = b.schema.get_field_index("text")
        margins = np.clip(model.margins(*utf8(b.column(k))), -30, 30)
        yield pa.RecordBatch.from_arrays([*(c for j, c in enumerate(b.columns) if j != k), pa.array(1 / (1 + np.exp(-2 * margins)))], names=[*(n for n in b.schema.names if n != "text"), "score"])


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of each document."""
    rows = pick(docs, {"doc_id": doc_id, "text": text})
    return rows.mapInArrow(lambda it: _score(small_batches(it, "text"), model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, text):
            yield b.filter(pa.array(model.margins(*utf8(b.column(b.schema.get_field_index(text)))) >= 0))

    return docs.mapInArrow(keep, docs.schema)


