"""Regression by hinge functions (after MARS, Friedman, 1991), additive in the columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Hinge functions whose products are gathered.
MOST_HINGES = 1_000


@dataclass(frozen=True)
class Hinge:
    """max(0, x - knot), or max(0, knot - x)."""

    column: str
    knot: float
    up: bool

    def value(self) -> Column:
        x = F.col(self.column).cast("double")
        return F.greatest((x - self.knot) if self.up else (self.knot - x), F.lit(0.0))


def products(df: DataFrame, columns: list[str], target: str, hinges: list[Hinge]) -> np.ndarray:
    """Sums of products of 1, all hinges and the target: a matrix of bounded size, added up batch by batch and then over tasks."""
    # plain values, which travel with the task
    places = [(columns.index(h.column), h.knot, 1.0 if h.up else -1.0) for h in hinges]
    size = len(hinges) + 2

    def run(it):
        total = np.zeros((size, size))
        for batch in it:
            x = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns) + 1)]
            basis = np.stack([np.ones(batch.num_rows), *(np.maximum(sign * (x[i] - knot), 0.0) for i, knot, sign in places), x[-1]])
            total += basis @ basis.T
        yield pa.record_batch({"k": pa.array(np.arange(size * size)), "v": pa.array(total.ravel())})

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias("_y")).dropna()
    sums = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()
    return sums["v"].to_numpy().reshape(size, size) if len(sums) else np.zeros((size, size))


def _solved(gram: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients of the chosen functions, and the sum of squared errors that they leave."""
    a, b = gram[np.ix_(chosen, chosen)], gram[chosen, -1]
    beta = np.linalg.lstsq(a + 1e-10 * np.trace(a) / len(chosen) * np.eye(len(chosen)), b, rcond=None)[0]
    return beta, max(float(gram[-1, -1] - 2 * beta @ b + beta @ a @ beta), 0.0)


def earth(df: DataFrame, columns: list[str], target: str, knots: int = 9, most: int = 11, penalty: float = 2.0) -> tuple[list[tuple[Hinge | None, float]], Column]:
    """Terms (the first is the intercept) with coefficients, and the prediction.

    Knots are quantiles of each column. Forwards, the pair of hinges at a knot that
    leaves the least error joins; backwards, terms go while that lowers the
    generalised cross-validation error. All of it is algebra on one matrix.
    """
    steps = [k / (knots + 1) for k in range(1, knots + 1)]
    cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, 10_000).alias(c) for c in columns]).first()
    places = [(c, float(k)) for c in columns for k in dict.fromkeys(cuts[c] or [])]
    hinges = [Hinge(c, k, up) for c, k in places for up in (True, False)]
    if len(hinges) > MOST_HINGES:
        raise ValueError(f"more than {MOST_HINGES} hinge functions: ask for fewer knots")
    gram = products(df, columns, target, hinges)
    n = gram[0, 0]
    # knots cost degrees of freedom, too
    gcv = lambda error, terms: error / n / max(1 - (terms + penalty * (terms - 1) / 2) / n, 1e-9) ** 2
    chosen = [0]
    while len(chosen) + 2 <= most:
        ways = [(_solved(gram, [*chosen, i, i + 1])[1], i) for i in range(1, len(hinges) + 1, 2) if i not in chosen]
        if not ways or min(ways)[0] >= _solved(gram, chosen)[1] * (1 - 1e-6):
            break
        chosen += [min(ways)[1], min(ways)[1] + 1]
    best, now = list(chosen), list(chosen)
    while len(now) > 1:
        now = min(([x for x in now if x != gone] for gone in now[1:]), key=lambda c: _solved(gram, c)[1])
        if gcv(_solved(gram, now)[1], len(now)) <= gcv(_solved(gram, best)[1], len(best)):
            best = list(now)
    beta = _solved(gram, best)[0]
    terms = [(None if i == 0 else hinges[i - 1], float(b)) for i, b in zip(best, beta, strict=True)]
    out = F.lit(0.0)
    for hinge, b in terms:
        out = out + (b if hinge is None else hinge.value() * b)
    return terms, out
