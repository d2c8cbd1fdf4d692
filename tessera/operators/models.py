"""Learners that MLlib fits in parallel, and ways to compose learners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..lineage import cut

#: A learner: (train, rows) -> rows with a column `predicted`.
Learner = Callable[[DataFrame, DataFrame], DataFrame]


def _ml(estimator, columns: list[str], target: str) -> Learner:
    def learn(train: DataFrame, rows: DataFrame) -> DataFrame:
        model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_features"), estimator]).fit(train.where(F.col(target).isNotNull()))
        return model.transform(rows).withColumn("predicted", F.col("prediction")).drop("_features", "rawPrediction", "prediction", "probability")

    return learn


def logistic_regression(columns: list[str], target: str, **options) -> Learner:
    from pyspark.ml.classification import LogisticRegression

    return _ml(LogisticRegression(featuresCol="_features", labelCol=target, **options), columns, target)


def linear_svm(columns: list[str], target: str, **options) -> Learner:
    from pyspark.ml.classification import LinearSVC

    return _ml(LinearSVC(featuresCol="_features", labelCol=target, **options), columns, target)


def random_forest(columns: list[str], target: str, **options) -> Learner:
    from pyspark.ml.classification import RandomForestClassifier

    return _ml(RandomForestClassifier(featuresCol="_features", labelCol=target, **options), columns, target)


def regression_tree(columns: list[str], target: str, **options) -> Learner:
    from pyspark.ml.regression import DecisionTreeRegressor

    return _ml(DecisionTreeRegressor(featuresCol="_features", labelCol=target, **options), columns, target)


def linear_regression(columns: list[str], target: str, **options) -> Learner:
    from pyspark.ml.regression import LinearRegression

    return _ml(LinearRegression(featuresCol="_features", labelCol=target, solver="normal", **options), columns, target)


def bagged(learner: Learner, key: str, n: int = 10, seed: int = 0) -> Learner:
    """A vote of learners over samples with replacement."""

    def learn(train: DataFrame, rows: DataFrame) -> DataFrame:
        votes = None
        for i in range(n):
            one = learner(train.sample(True, 1.0, seed + i), rows).select(key, "predicted")
            votes = one if votes is None else votes.union(one)
        return rows.join(votes.groupBy(key).agg(F.mode("predicted", True).alias("predicted")), key)

    return learn


def one_against_all(learner: Callable[[str], Callable[[DataFrame, DataFrame], DataFrame]], classes: list[str], cls: str, key: str, score: str = "p") -> Learner:
    """The class whose own two-class learner scores highest; `learner(target)` must add `score`."""

    def learn(train: DataFrame, rows: DataFrame) -> DataFrame:
        found = None
        for c in classes:
            t = train.withColumn("_y", (F.col(cls) == c).cast("double"))
            one = learner("_y")(t, rows).select(key, F.lit(c).alias("_c"), F.col(score).alias("_s"))
            found = one if found is None else found.union(one)
        best = found.groupBy(key).agg(F.max_by("_c", "_s").alias("predicted"))
        return rows.join(best, key)

    return learn


def boosted(learner: Callable[[str], Learner], cls: str, key: str, n: int = 5) -> Learner:
    """AdaBoost.M1: weights of rows that a round gets right shrink by its odds; rounds vote by their log odds.

    `learner(weight)` learns with a weight column. Each round's weights are
    written to the checkpoint folder, which cuts the plan.
    """
    import math

    def learn(train: DataFrame, rows: DataFrame) -> DataFrame:
        now, votes = train.withColumn("_bw", F.lit(1.0)), None
        for _ in range(n):
            fit = learner("_bw")
            told = fit(now, now).select(key, (F.col("predicted") == F.col(cls)).alias("_right"))
            now = now.join(told, key)
            r = now.agg(F.sum(F.when(~F.col("_right"), F.col("_bw")).otherwise(0.0)).alias("e"), F.sum("_bw").alias("n")).first()
            e = r.e / r.n
            if e >= 0.5:
                break
            beta = max(e, 1e-10) / (1 - e)
            one = fit(now.drop("_right"), rows).select(key, "predicted", F.lit(math.log(1 / beta)).alias("_v"))
            votes = one if votes is None else votes.union(one)
            if e == 0:
                break
            now = cut(now.withColumn("_bw", F.when(F.col("_right"), F.col("_bw") * beta).otherwise(F.col("_bw"))).drop("_right"))
        if votes is None:
            return learner("_bw")(now.drop("_right"), rows)
        sums = votes.groupBy(key, "predicted").agg(F.sum("_v").alias("_v")).groupBy(key).agg(F.max_by("predicted", "_v").alias("predicted"))
        return rows.join(sums, key)

    return learn


def cross_validated(df: DataFrame, learner: Learner, folds: int, key: list[str], stratify: str | None = None) -> DataFrame:
    """Every row with a prediction by a learner that has not seen its fold. The folds are dealt once."""
    from ..lineage import cut
    from .sampling import folds as dealt

    numbered = cut(dealt(df, folds, key, stratify, "fold"))
    out = None
    for f in range(folds):
        test = numbered.where(F.col("fold") == f)
        one = learner(numbered.where(F.col("fold") != f).drop("fold"), test)
        out = one if out is None else out.unionByName(one)
    return out


def tuned(df: DataFrame, learners: dict[str, Learner], measure: Callable[[DataFrame], float], folds: int, key: list[str]) -> str:
    """The name of the learner that cross-validates best, the first of several."""
    scores = {name: measure(cross_validated(df, learner, folds, key)) for name, learner in learners.items()}
    return max(scores, key=lambda n: (scores[n], -list(scores).index(n)))


def learning_curve(df: DataFrame, learner: Learner, measure: Callable[[DataFrame], float], shares: list[float], key: list[str]) -> list[tuple[float, float]]:
    """(share, measure) of learning from a share of one part and testing on the other."""
    from .sampling import two_parts

    parts = two_parts(df, 0.7, key, name="_half")
    train, test = parts.where("_half = 0").drop("_half"), parts.where("_half = 1").drop("_half")
    out = []
    for s in shares:
        some = two_parts(train, s, key, name="_some").where("_some = 0").drop("_some")
        out.append((s, measure(learner(some, test))))
    return out


#: Rows that leave-one-out may hold out one by one.
MOST_LEFT_OUT = 1_000


def leave_one_out(df: DataFrame, learner: Learner, key: list[str]) -> DataFrame:
    """Every row with a prediction by a learner from all others."""
    n = df.count()
    if n > MOST_LEFT_OUT:
        raise ValueError(f"more than {MOST_LEFT_OUT} rows: cross-validate")
    return cross_validated(df, learner, n, key)


def proportion_test(df: DataFrame, learner: Learner, share: float, times: int, key: list[str], stratify: str | None = None) -> DataFrame:
    """Rows held out by repeated random splits, with `round` and the prediction of a learner from the rest."""
    from .sampling import order_key, two_parts

    out = None
    for t in range(times):
        # another order of rows each time
        parts = two_parts(df.withColumn("_o", order_key(key, t + 1)), share, ["_o", *key], stratify, "_part").drop("_o")
        one = learner(parts.where("_part = 0").drop("_part"), parts.where("_part = 1").drop("_part")).withColumn("round", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def tested_by(df: DataFrame, learner: Learner, fold: str, cls: str) -> DataFrame:
    """Predictions of every fold of a given index by the others; the class is hidden from what is tested."""
    out = None
    for r in sorted(r[0] for r in df.select(fold).distinct().collect()):
        test = df.where(F.col(fold) == r).withColumn("_actual", F.col(cls)).withColumn(cls, F.lit(None).cast(df.schema[cls].dataType))
        one = learner(df.where(F.col(fold) != r), test).withColumn(cls, F.col("_actual")).drop("_actual")
        out = one if out is None else out.unionByName(one)
    return out


def with_predictions(rows: DataFrame, train: DataFrame, learners: dict[str, Learner], key: str) -> DataFrame:
    """`rows` with a column of predictions for each learner."""
    for name, learner in learners.items():
        rows = rows.join(learner(train, rows).select(F.col(key).alias("_k"), F.col("predicted").alias(name)), F.col(key) == F.col("_k")).drop("_k")
    return rows


def random_classifier(cls: str, key: list[str], seed: int = 0) -> Learner:
    """Draws by the shares of classes, repeatably: a hash of the row picks the place."""

    def learn(train: DataFrame, rows: DataFrame) -> DataFrame:
        from .ordered import running

        counts = train.where(F.col(cls).isNotNull()).groupBy(F.col(cls).alias("predicted")).agg(F.count(F.lit(1)).alias("_n"))
        total = counts.agg(F.sum("_n").alias("_t"))
        steps = running(counts, "predicted", {"_hi": F.col("_n")}).crossJoin(F.broadcast(total)).select("predicted", ((F.col("_hi") - F.col("_n")) / F.col("_t")).alias("_lo"), (F.col("_hi") / F.col("_t")).alias("_up"))
        u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
        # a row for each class
        return rows.withColumn("_u", u).join(F.broadcast(steps), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_up"))).drop("_u", "_lo", "_up")

    return learn


def prepared(steps: list[Callable[[DataFrame], Callable[[DataFrame], DataFrame]]], learner: Learner) -> Learner:
    """A learner behind preprocessors; a step fits on the training rows and gives what is applied to both tables."""

    def learn(train: DataFrame, rows: DataFrame) -> DataFrame:
        for step in steps:
            apply = step(train)
            train, rows = apply(train), apply(rows)
        return learner(train, rows)

    return learn


def multi_target(learner: Callable[[str], Learner], targets: list[str], key: str) -> Learner:
    """A model for each target; predictions as predicted_<target>."""

    def learn(train: DataFrame, rows: DataFrame) -> DataFrame:
        return with_predictions(rows, train, {f"predicted_{t}": learner(t) for t in targets}, key)

    return learn


def stepwise(df: DataFrame, columns: list[str], learner: Callable[[list[str]], Learner], measure: Callable[[DataFrame], float], folds: int, key: list[str], least: float = 1e-6) -> list[str]:
    """Columns chosen forwards and backwards by a cross-validated measure, until no step gains."""
    chosen: list[str] = []
    best = float("-inf")
    tried: dict[tuple[str, ...], float] = {}

    def score(some: list[str]) -> float:
        name = tuple(sorted(some))
        if name not in tried:
            tried[name] = measure(cross_validated(df, learner(list(name)), folds, key))
        return tried[name]

    while True:
        steps = [[*chosen, c] for c in columns if c not in chosen] + ([[x for x in chosen if x != c] for c in chosen] if len(chosen) > 1 else [])
        ahead = max(steps, key=lambda s: (score(s), -len(s), s), default=None)
        if ahead is None or score(ahead) <= best + least:
            return sorted(chosen)
        chosen, best = ahead, score(ahead)


def eliminated(df: DataFrame, columns: list[str], cls: str, keep: int) -> list[str]:
    """Recursive elimination: the column of least squared weight in a linear SVM goes, until `keep` are left."""
    left = list(columns)
    while len(left) > keep:
        weights = svm_weights(df, left, cls)
        left.remove(min(left, key=lambda c: (weights[c], c)))
    return left


def svm_weights(df: DataFrame, columns: list[str], cls: str, **options) -> dict[str, float]:
    """Squared weights of a linear SVM over standardised columns."""
    from pyspark.ml.classification import LinearSVC

    rows = VectorAssembler(inputCols=columns, outputCol="_features").transform(df.where(F.col(cls).isNotNull()))
    fit = LinearSVC(featuresCol="_features", labelCol=cls, standardization=True, maxIter=50, **options).fit(rows)
    deviations = rows.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return {c: float(w * (deviations[c] or 0.0)) ** 2 for c, w in zip(columns, fit.coefficients, strict=True)}


def forest_importance(df: DataFrame, columns: list[str], cls: str, **options) -> dict[str, float]:
    """Importance of columns in a random forest."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = VectorAssembler(inputCols=columns, outputCol="_features").transform(df.where(F.col(cls).isNotNull()))
    fit = RandomForestClassifier(featuresCol="_features", labelCol=cls, seed=0, **options).fit(rows)
    return dict(zip(columns, (float(x) for x in fit.featureImportances.toArray()), strict=True))


def pls(df: DataFrame, columns: list[str], target: str, parts: int) -> tuple[float, dict[str, float]]:
    """Intercept and coefficients of a partial least squares regression (NIPALS over the cross products of one aggregate)."""
    import numpy as np

    names = [*columns, target]
    x = [F.col(c).cast("double") for c in names]
    n = len(names)
    known = df.dropna(subset=names)
    r = known.agg(*[F.avg(v) for v in x], *[F.covar_pop(x[i], x[j]) for i in range(n) for j in range(i, n)]).first()
    means, cov, at = np.array(r[:n], float), np.zeros((n, n)), n
    for i in range(n):
        for j in range(i, n):
            cov[i, j] = cov[j, i] = r[at]
            at += 1
    scale = np.sqrt(np.diag(cov))
    scale[scale == 0] = 1.0
    corr = cov / np.outer(scale, scale)
    a, b = corr[:-1, :-1], corr[:-1, -1]
    weights, loads, q = [], [], []
    for _ in range(min(parts, n - 1)):
        w = b / (np.linalg.norm(b) or 1.0)
        t = w @ a @ w
        if t < 1e-12:
            break
        p = a @ w / t
        q.append(w @ b / t)
        weights.append(w)
        loads.append(p)
        b = b - p * q[-1] * t
        a = a - np.outer(p, p) * t
    w, p = np.array(weights).T, np.array(loads).T
    beta = w @ np.linalg.solve(p.T @ w, np.array(q)) if weights else np.zeros(n - 1)
    beta = beta * scale[-1] / scale[:-1]
    return float(means[-1] - beta @ means[:-1]), dict(zip(columns, beta.tolist(), strict=True))
