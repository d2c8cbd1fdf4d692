"""Quality of texts by a hashed word n-gram logistic regression.

Tokens are runs of letters and digits, or of other characters; features are
words, pairs of words, and runs of up to three token shapes (capitals, digits,
a word said again, the characters themselves). They are hashed into 2**BITS
places; a feature's value is the square root of its share of the text's
features of that kind. Weights come from follow-the-regularised-leader updates,
in one task over a bounded sample of labelled rows (at most TRAIN_ROWS, and whole
texts of TRAIN_CHARS characters together, in the order of a hash); a score is a sparse dot
product with them, in any number of tasks.

Null and empty texts have no features and score by the intercept. Without
labels, the intercept is that of nine documents of label 1 and one of label 0.
Repeated rows are each scored; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _ftrl
from ._text import BLOCK, batches, chunks, mix, release, span_hashes, text_chunks

BITS = 18
#: Labelled rows, and characters of their texts, from which weights are learnt, at most.
TRAIN_ROWS = 6_000
TRAIN_CHARS = 64 << 20
THRESHOLD = 0.3

_KIND = np.full(256, 2, np.int8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _count(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[end] - total[start]


def features(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and value of every feature, sorted by text."""
    raw = np.frombuffer(b" ".join(items) + b" ", np.uint8)
    kind = _KIND[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    edge = np.flatnonzero(new)
    end = np.append(edge[1:], len(raw))
    token = kind[edge] > 0
    start, end = edge[token], end[token]
    limits = np.cumsum([len(x) + 1 for x in items])
    text = np.searchsorted(limits, start, "right")
    word = kind[start] == 1
    low = _LOW[raw]
    hashes = span_hashes(low, start, end)
    capital, small, digit = (_count(f, start, end) for f in ((raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122), (raw >= 48) & (raw <= 57)))
    said = np.zeros(len(start), bool)
    at = np.flatnonzero(word)
    if len(at) > 1:
        said[at[1:]] = (hashes[at[1:]] == hashes[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
    shape = (1 + 2 * ((capital > 1) & (small == 0)) + 4 * (digit > 0) + 8 * said).astype(np.uint64)
    shape = np.where(word, shape, hashes)
    places, owners, sizes = [], [], []
    for seed, values, length in ((11, hashes, 1), (12, hashes, 2), (21, shape, 1), (22, shape, 2), (23, shape, 3)):
        n = len(values) - length + 1
        if n <= 0:
            continue
        h = np.full(n, np.uint64(seed))
        for k in range(length):
            h = mix(h + values[k : k + n])
        same = text[:n] == text[length - 1 :]
        own = text[:n][same]
        places.append((h[same] & np.uint64((1 << BITS) - 1)).astype(np.int64))
        owners.append(own)
        sizes.append(np.bincount(own, minlength=len(items))[own])
    if not places:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float)
    key, first, count = np.unique((np.concatenate(owners) << BITS) | np.concatenate(places), return_index=True, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.sqrt(count / np.concatenate(sizes)[first])


def fit(items: list[bytes], labels: list[float], **options) -> tuple[np.ndarray, float]:
    bias = _ftrl.prior(labels, 9, 1)
    examples = []
    for a, b in chunks(items, BLOCK):
        owner, place, value = features(items[a:b])
        place, value = place.astype(np.int32), value.astype(np.float32)
        cut = np.searchsorted(owner, np.arange(b - a + 1))
        examples += [(place[cut[d] : cut[d + 1]], value[cut[d] : cut[d + 1]]) for d in range(b - a)]
    return _ftrl.train(examples, labels, 1 << BITS, bias, **({"alpha": 0.5, "l1": 0.1, "l2": 0.1} | options))


def score(items: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(items), bias)
    for a, b in chunks(items, BLOCK):
        owner, place, value = features(items[a:b])
        out[a:b] += np.bincount(owner, weights=weights[place] * value, minlength=b - a)
    return _ftrl.sigmoid(out)


def classify(documents: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    spark = documents.sparkSession
    sample = _ftrl.labelled_sample(documents, labels, "quality", _ftrl.fold(modulus) != held, train_rows)

    def learn(it):
        items, y = _ftrl.bounded(it, TRAIN_CHARS)
        weights, bias = fit([x.encode() for x in items], y)
        del items
        at = np.flatnonzero(weights)
        yield pa.record_batch({"place": pa.array(np.append(at, -1)), "weight": pa.array(np.append(weights[at], bias))})
        release()

    rows = sample.repartition(1).sortWithinPartitions("rank").select("text", "y").mapInArrow(learn, "place long, weight double").toPandas()
    weights = np.zeros(1 << BITS, np.float32)
    place, value = rows["place"].to_numpy(), rows["weight"].to_numpy()
    weights[place[place >= 0]] = value[place >= 0]
    # an empty sample may reach no task at all
    model = spark.sparkContext.broadcast((weights, float(value[place < 0][0]) if (place < 0).any() else _ftrl.prior([], 9, 1)))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def apply(it):
        for batch in it:
            s = np.concatenate([np.zeros(0), *(score(items, *model.value) for _, _, items in text_chunks(batch.column(2)))])
            yield batches(schema, doc_id=batch.column(0), held_out=batch.column(1), score=s, predicted=(s >= THRESHOLD).astype(np.int32))

    inputs = documents.select(F.col("doc_id").cast("long"), (_ftrl.fold(modulus) == held).alias("held_out"), "text")
    return inputs.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
