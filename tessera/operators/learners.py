"""Simple learners as tables: majority, naive Bayes, nearest neighbours, lookup, linear regression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.stats import distribution, domain_contingency, modus, probabilities, unpivot
from .ordered import running


def majority(train: DataFrame, rows: DataFrame, cls: str) -> DataFrame:
    """`rows` with `predicted`, the most frequent class."""
    return rows.join(F.broadcast(modus(distribution(train, cls)).select(F.col("value").alias("predicted"))))


def naive_bayes(train: DataFrame, columns: list[str], cls: str, m: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Priors (class, p), and log ratios (variable, value, class, r) of p(c|a) to p(c); missing values don't occur.

    Without m, conditional probabilities are relative frequencies by Laplace's rule.
    """
    prior = probabilities(distribution(train, cls)).select(F.col("value").alias("class"), "p")
    t = domain_contingency(train, columns, cls)
    values = t.groupBy("variable", "value").agg(F.sum("w").alias("n"))
    grid = values.join(F.broadcast(prior)).join(t, ["variable", "value", "class"], "left").fillna(0.0, ["w"])
    k = prior.count()
    p = (F.col("w") + 1) / (F.col("n") + k) if m is None else (F.col("w") + m * F.col("p")) / (F.col("n") + m)
    return prior, grid.select("variable", "value", "class", F.ln(p / F.col("p")).alias("r"))


def naive_bayes_probabilities(model: tuple[DataFrame, DataFrame], rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, class, probability: rows are unpivoted and meet the table of ratios."""
    prior, ratios = model
    long = unpivot(rows, columns, [key], as_text=True).where(F.col("value").isNotNull())
    sums = long.join(ratios, ["variable", "value"]).groupBy(key, "class").agg(F.sum("r").alias("s"))
    grid = rows.select(key).join(F.broadcast(prior)).join(sums, [key, "class"], "left")
    score = grid.withColumn("s", F.ln("p") + F.coalesce("s", F.lit(0.0)))
    top = score.withColumn("e", F.exp(F.col("s") - F.max("s").over(Window.partitionBy(key))))
    return top.select(key, "class", (F.col("e") / F.sum("e").over(Window.partitionBy(key))).alias("probability"))


def predicted(probabilities_: DataFrame, key: str) -> DataFrame:
    """key, predicted: the likeliest class, the least of several (within 1e-9)."""
    return probabilities_.groupBy(key).agg(F.min(F.struct((-F.round("probability", 9)).alias("p"), "class")).alias("b")).select(key, F.col("b.class").alias("predicted"))


def knn_votes(neighbours: DataFrame, classes: DataFrame, k: int, how: str = "distance") -> DataFrame:
    """query, class, vote of neighbours (query, rank, neighbour, d); `classes` is (neighbour, class).

    Weights fall as a bell over ranks or distances, to 0.001 at the last.
    """
    if how == "rank":
        w = F.exp(-F.col("rank") * F.col("rank") / F.lit(k * k / -math.log(0.001)))
        t = neighbours.withColumn("vote", w)
    else:
        last = F.max("d").over(Window.partitionBy("query"))
        t = neighbours.withColumn("vote", F.when(last < 1e-6, 1.0).otherwise(F.exp(F.col("d") * F.col("d") * math.log(0.001) / (last * last))))
    s = t.join(classes, "neighbour").groupBy("query", "class").agg(F.sum("vote").alias("vote"))
    return s.withColumn("vote", F.col("vote") / F.sum("vote").over(Window.partitionBy("query")))


def lookup(train: DataFrame, rows: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """`rows` with the most frequent class of their keys in `train`."""
    table = train.where(F.col(cls).isNotNull()).groupBy(*keys).agg(F.mode(cls, True).alias("predicted"))
    return rows.join(table, keys, "left")


def linear_regression(df: DataFrame, columns: list[str], target: str) -> list[tuple[str, float, float, float]]:
    """(name, coefficient, standard error, t) by the normal equations.

    One aggregate gathers the cross products, of which there are as many as
    pairs of columns; they are solved on the driver.
    """
    import numpy as np

    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    y = F.col(target).cast("double")
    n = len(x)
    rows = df.where(F.col(target).isNotNull())
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    r = rows.agg(*[F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)], *[F.sum(v * y) for v in x], F.sum(y * y), F.count(F.lit(1))).first()
    a, at = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = r[at]
            at += 1
    b = np.array(r[at : at + n], float)
    beta = np.linalg.solve(a, b)
    rss = float(r[at + n]) - float(beta @ b)
    se = np.sqrt(np.diag(np.linalg.inv(a)) * rss / max(1, r[at + n + 1] - n))
    return [(name, float(v), float(s), float(v / s) if s else math.inf) for name, v, s in zip(["intercept", *columns], beta, se, strict=True)]


def logistic(x: list[Column], beta: list[float]) -> Column:
    z = F.lit(beta[0])
    for c, b in zip(x, beta[1:], strict=True):
        z = z + c * b
    return 1 / (1 + F.exp(-z))


def best_threshold(scored: DataFrame, p: str, y: str) -> DataFrame:
    """threshold, ca: the probability from which class 1 gives most right answers, the least of several."""
    c = scored.groupBy(F.col(p).alias("threshold")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    upto = running(c, "threshold", {"_un": F.col("neg"), "_up": F.col("pos")})
    t = upto.join(F.broadcast(c.agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))))
    right = F.col("_un") - F.col("neg") + F.col("_pos") - F.col("_up") + F.col("pos")
    ca = t.select("threshold", (right / (F.col("_pos") + F.col("_neg"))).alias("ca"))
    return ca.groupBy().agg(F.max(F.struct("ca", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.ca").alias("ca"))


def interpolated(x: Column, points: list[tuple[float, float]]) -> Column:
    """A curve through points, straight between them and level beyond."""
    points = sorted(points)
    out = F.lit(points[-1][1])
    for (a, ya), (b, yb) in zip(reversed(points[:-1]), reversed(points[1:]), strict=True):
        out = F.when(x < b, ya + (x - a) / ((b - a) or 1.0) * (yb - ya)).otherwise(out)
    return F.when(x.isNotNull(), F.when(x < points[0][0], points[0][1]).otherwise(out))


def loess_bayes(train: DataFrame, continuous: list[str], cls: str, points: int = 11, share: float = 0.5) -> dict[str, Column]:
    """The probability of each class as an expression: shares of classes times, for each continuous column, the ratio of a local regression of the class to its share.

    A curve is fitted at a few points, by aggregates, and interpolated. A missing value says nothing.
    """
    from ..functions.comparisons import grid_points, loess

    known = train.where(F.col(cls).isNotNull())
    n = {r[0]: r[1] for r in known.groupBy(cls).count().collect()}
    total = sum(n.values())
    scores = {}
    for c, w in n.items():
        score = F.lit(math.log(w / total))
        y = known.withColumn("_y", (F.col(cls) == c).cast("double"))
        for x in continuous:
            curve = [(r.point, max(r.y, 1e-6)) for r in loess(y, x, "_y", grid_points(known, x, points), share).collect()]
            score = score + F.coalesce(F.ln(interpolated(F.col(x).cast("double"), curve)) - math.log(w / total), F.lit(0.0))
        scores[c] = score
    most = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    e = {c: F.exp(s - most) for c, s in scores.items()}
    whole = sum(e.values(), F.lit(0.0))
    return {c: x / whole for c, x in e.items()}
