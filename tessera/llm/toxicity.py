"""Toxicity of texts by a character n-gram linear classifier with naive Bayes scaling.

A feature says whether a run of 4 to 6 characters (in lower case, spaces at both
ends of a text) occurs in a text. All features are hashed into 2**BITS places and
scaled by their place's log-count ratio among toxic and other texts (Wang and
Manning, 2012); a logistic model is then trained on all of them, whose L1 term sets
most weights to 0. Scores are sparse dot products with the others.

Counts and weights come from one task over a bounded sample of labelled rows: at
most TRAIN_ROWS, and whole texts of TRAIN_CHARS characters together, in the order of a hash.
Null and empty texts have no features and score by the intercept. Without labels,
the intercept is that of one toxic document and nine others. Repeated rows are
each scored; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _ftrl
from ._text import batches, chunks, mix, release, text_chunks

ORDERS = (4, 5, 6)
#: Labelled rows, and characters of their texts, from which weights are learnt, at most.
TRAIN_ROWS = 5_000
TRAIN_CHARS = 32 << 20
BITS = 22
THRESHOLD = 0.3
_EDGE = 0x110000  # no character


def ngrams(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram, and the text that it is from."""
    raw = np.frombuffer("\0".join(f" {x.lower()} " for x in items).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(x.lower()) + 3 for x in items), np.int64, len(items))
    code = raw.astype(np.uint64)
    edges = np.cumsum(sizes)[:-1] - 1
    code[edges] = _EDGE
    text = np.repeat(np.arange(len(items)), sizes)[: len(code)]
    out, owner = [], []
    h = code
    for order in range(2, ORDERS[-1] + 1):
        h = h[:-1] * np.uint64(0x1000001B3) + code[order - 1 :]
        if order in ORDERS and len(h):
            own = text[: len(h)]
            whole = own == text[order - 1 :]
            whole &= code[order - 1 :] != _EDGE
            out.append(mix(h[whole] + np.uint64(order << 56)))
            owner.append(own[whole])
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def places(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The place of every n-gram, and the text that it is from."""
    h, own = ngrams(items)
    return (h >> np.uint64(64 - BITS)).astype(np.int32), own


def fit(items: list[str], labels: list[float]) -> tuple[np.ndarray, np.ndarray, float]:
    """The places with a weight, in order, their weights, and the intercept."""
    y = np.asarray(labels, float)
    bias = _ftrl.prior(y, 1, 9)
    if not y.sum() or y.sum() == len(y):
        return np.zeros(0, np.int64), np.zeros(0), bias
    own = [np.unique(places([x])[0]) for x in items]
    ratio = log_count_ratios(own, y)
    weights, bias = _ftrl.train(_Scaled(own, ratio), y.tolist(), 1 << BITS, bias, alpha=0.1, l1=8.0, l2=0.5, epochs=3)
    at = np.flatnonzero(weights * ratio)
    return at, (weights * ratio)[at], bias


def log_count_ratios(own: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each place: log of its share among toxic texts to that among others, 0 where no text has it."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for at, label in zip(own, y, strict=True):
        counts[int(label)][at] += 1
    q, p = counts
    return np.where(p + q > 0, np.log((p + 0.5) / (y.sum() + 1)) - np.log((q + 0.5) / (len(y) - y.sum() + 1)), 0.0)


class _Scaled:
    """Examples whose values are looked up when they are asked for."""

    def __init__(self, own: list[np.ndarray], ratio: np.ndarray):
        self.own, self.ratio = own, ratio

    def __len__(self) -> int:
        return len(self.own)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.own[k], self.ratio[self.own[k]]


class Scorer:
    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.at, self.weights, self.bias = at, weights, bias
        self.map = np.zeros(1 << BITS, bool)
        self.map[at] = True

    def score(self, items: list[str]) -> np.ndarray:
        out = np.full(len(items), self.bias)
        if len(self.at):
            for a, b in chunks(items, 1 << 18):
                h, own = places(items[a:b])
                hit = self.map[h]
                key = np.unique((own[hit] << BITS) + h[hit])
                out[a:b] += np.bincount(key >> BITS, weights=self.weights[np.searchsorted(self.at, key & ((1 << BITS) - 1))], minlength=b - a)
        return _ftrl.sigmoid(out)


def scores(model: Scorer, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.score([x.decode("utf-8", "replace") for x in items]) for _, _, items in text_chunks(column))])


def fit_on(documents: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, train_rows: int = TRAIN_ROWS) -> Scorer:
    """The classifier, learnt from the labelled rows that are not held out."""
    sample = _ftrl.labelled_sample(documents, labels, "toxic", _ftrl.fold(modulus) != held, train_rows)

    def learn(it):
        at, weights, bias = fit(*_ftrl.bounded(it, TRAIN_CHARS))
        yield pa.record_batch({"place": pa.array(np.append(at, -1)), "weight": pa.array(np.append(weights, bias))})
        release()

    rows = sample.repartition(1).sortWithinPartitions("rank").select("text", "y").mapInArrow(learn, "place long, weight double").toPandas()
    at, value = rows["place"].to_numpy(), rows["weight"].to_numpy()
    # an empty sample may reach no task at all
    return Scorer(at[at >= 0], value[at >= 0], float(value[at < 0][0]) if (at < 0).any() else math.log(1 / 9))


def classify(documents: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    model = documents.sparkSession.sparkContext.broadcast(fit_on(documents, labels, modulus, held, train_rows))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def apply(it):
        for batch in it:
            s = scores(model.value, batch.column(2))
            yield batches(schema, doc_id=batch.column(0), held_out=batch.column(1), score=s, predicted=(s >= THRESHOLD).astype(np.int32))

    inputs = documents.select(F.col("doc_id").cast("long"), (_ftrl.fold(modulus) == held).alias("held_out"), "text")
    return inputs.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep(documents: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `documents` that are not found toxic, unchanged."""
    model = documents.sparkSession.sparkContext.broadcast(fit_on(documents, labels, modulus, held, train_rows))

    def apply(it):
        for batch in it:
            s = scores(model.value, batch.column("text"))
            yield batch.filter(pa.array(s < THRESHOLD))

    return documents.mapInArrow(apply, documents.schema)
