"""Follow-the-regularised-leader training of sparse logistic models (McMahan et al., 2013)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(examples, labels, dim: int, bias: float, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, epochs: int = 4) -> tuple[np.ndarray, float]:
    """Weights and intercept; each example is (indices, values) without repeated indices."""
    z, n = np.zeros(dim), np.zeros(dim)
    zb = nb = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)).tolist():
            at, x = examples[k]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            b = bias - zb / ((beta + math.sqrt(nb)) / alpha)
            g = float(sigmoid(float(w @ x) + b)) - labels[k]
            gx = g * x
            new = ni + gx * gx
            z[at] = zi + gx - (np.sqrt(new) - np.sqrt(ni)) / alpha * w
            n[at] = new
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * (b - bias)
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, bias - zb / ((beta + math.sqrt(nb)) / alpha)


def prior(labels, ones: float, zeros: float) -> float:
    """Log odds of label 1 with pseudo-counts, which alone count where there are no labels."""
    labels = np.asarray(labels, float)
    return math.log((labels.sum() + ones) / (len(labels) - labels.sum() + zeros))


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """text, y, rank of at most `rows` labelled documents, chosen by a hash of doc_id, in the order of `rank`.

    Only `rows` ids are broadcast. Labels that contradict each other for one
    doc_id, and null labels, teach nothing.
    """
    y = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_most")).where("y = _most").drop("_most")
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = documents.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))
    return found.orderBy(F.xxhash64("_id"), "_id", F.crc32(F.col("text").cast("binary"))).limit(rows).select("text", F.col("y").cast("double").alias("y"), F.struct(F.xxhash64("_id"), "_id", F.crc32(F.col("text").cast("binary"))).alias("rank"))


def bounded(it, most: int) -> tuple[list[str], list[float]]:
    """Texts and labels of batches (text, y), up to `most` characters of whole texts; at least one text."""
    items: list[str] = []
    y: list[float] = []
    for batch in it:
        for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            most -= len(text or "")
            if most < 0 and items:
                return items, y
            items.append(text or "")
            y.append(label)
    return items, y
