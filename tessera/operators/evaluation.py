"""Measures of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import running


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """ca and its standard error."""
    ca = F.avg((F.col(actual) == F.col(predicted)).cast("double"))
    return df.agg(ca.alias("ca"), F.sqrt(ca * (1 - ca) / F.count(F.lit(1))).alias("se"))


def binary_measures(df: DataFrame, actual: Column, predicted: Column, alpha: float = 1.0) -> DataFrame:
    """tp, fn, fp, tn and what follows from them."""
    count = lambda a, p: F.sum((a & p).cast("double"))
    m = df.agg(count(actual, predicted).alias("tp"), count(actual, ~predicted).alias("fn"), count(~actual, predicted).alias("fp"), count(~actual, ~predicted).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    div = lambda a, b: a / F.nullif(b, F.lit(0.0))
    sens, spec, ppv, npv = div(tp, tp + fn), div(tn, tn + fp), div(tp, tp + fp), div(tn, tn + fn)
    n = tp + fn + fp + tn
    chance = (((tp + fn) + (tp + fp)) / (2 * n)) * (((tp + fn) + (tp + fp)) / (2 * n)) + (((tn + fp) + (tn + fn)) / (2 * n)) * (((tn + fp) + (tn + fn)) / (2 * n))
    return m.select("tp", "fn", "fp", "tn", sens.alias("sens"), spec.alias("spec"), ppv.alias("ppv"), npv.alias("npv"), div(2 * ppv * sens, ppv + sens).alias("f1"), div((1 + alpha) * ppv * sens, alpha * ppv + sens).alias("falpha"), div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), div((tp + tn) / n - chance, 1 - chance).alias("scott_pi"))


def probability_measures(df: DataFrame, p: Column, prior: Column) -> DataFrame:
    """ap and is of the probability and prior of the actual class."""
    info = F.when(p >= prior, F.log2(p) - F.log2(prior)).otherwise(-(F.log2(1 - p) - F.log2(1 - prior)))
    return df.agg(F.avg(p).alias("ap"), F.avg(info).alias("is"))


def brier(probabilities: DataFrame, key: str, actual: str) -> DataFrame:
    """Mean over rows of sum p^2 - 2 p(actual) + 1, from (key, class, probability, actual)."""
    p = F.col("probability")
    rows = probabilities.groupBy(key).agg((F.sum(p * p) - 2 * F.sum(F.when(F.col("class") == F.col(actual), p).otherwise(0.0)) + 1).alias("b"))
    return rows.agg(F.avg("b").alias("brier"))


def auc(df: DataFrame, p: str, positive: Column) -> DataFrame:
    """Concordance from the counts of each probability: auc, and concordant, discordant, tied pairs."""
    c = df.groupBy(F.col(p).alias("p")).agg(F.sum(positive.cast("double")).alias("pos"), F.sum((~positive).cast("double")).alias("neg"))
    t = running(c, "p", {"upto": F.col("neg")}).withColumn("below", F.col("upto") - F.col("neg")).agg(F.sum(F.col("below") * F.col("pos")).alias("concordant"), F.sum(F.col("neg") * F.col("pos")).alias("tied"), (F.sum("pos") * F.sum("neg")).alias("all"))
    return t.select(((F.col("concordant") + F.col("tied") / 2) / F.col("all")).alias("auc"), "concordant", (F.col("all") - F.col("concordant") - F.col("tied")).alias("discordant"), "tied")


def roc(df: DataFrame, p: str, positive: Column) -> DataFrame:
    """p, fpr, tpr: shares of the rows from p upwards."""
    c = df.groupBy(F.col(p).alias("p")).agg(F.sum(positive.cast("double")).alias("pos"), F.sum((~positive).cast("double")).alias("neg"))
    up = running(c, "p", {"fp": F.col("neg"), "tp": F.col("pos")}, descending=True)
    t = up.join(F.broadcast(c.agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))))
    return t.select("p", (F.col("fp") / F.col("_neg")).alias("fpr"), (F.col("tp") / F.col("_pos")).alias("tpr"))


def lift(df: DataFrame, p: str, positive: Column) -> DataFrame:
    """p, share of rows from p upwards, and how many positives are among them."""
    c = df.groupBy(F.col(p).alias("p")).agg(F.sum(positive.cast("double")).alias("pos"), F.count(F.lit(1)).alias("n"))
    up = running(c, "p", {"upto": F.col("n"), "tp": F.col("pos")}, descending=True)
    return up.join(F.broadcast(c.agg(F.sum("n").alias("_n")))).select("p", (F.col("upto") / F.col("_n")).alias("share"), "tp")


def regression_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """mse, rmse, mae, rse, rrse, rae, r2 (two passes: relative errors need the mean)."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    t = df.join(F.broadcast(df.agg(F.avg(actual).alias("_m"))))
    d = y - F.col("_m")
    rse = F.sum(e * e) / F.sum(d * d)
    return t.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), rse.alias("rse"), F.sqrt(rse).alias("rrse"), (F.sum(F.abs(e)) / F.sum(F.abs(d))).alias("rae"), (1 - rse).alias("r2"))


def mcnemar(df: DataFrame, actual: str, a: str, b: str) -> DataFrame:
    """chi2 of two predictions over rows that one of them gets right."""
    right = lambda c: F.col(c) == F.col(actual)
    t = df.agg(F.sum((right(a) & ~right(b)).cast("double")).alias("n01"), F.sum((~right(a) & right(b)).cast("double")).alias("n10"))
    d = F.abs(F.col("n01") - F.col("n10")) - 1
    return t.select("n01", "n10", F.when(F.col("n01") + F.col("n10") > 0, d * d / (F.col("n01") + F.col("n10"))).otherwise(0.0).alias("chi2"))


def total_cost(df: DataFrame, actual: str, predicted: str, costs: DataFrame) -> DataFrame:
    """Sum and mean of costs (actual, predicted, cost); pairs without one cost nothing."""
    c = costs.select(F.col("actual").alias("_a"), F.col("predicted").alias("_p"), "cost")
    t = df.join(F.broadcast(c), (F.col(actual) == F.col("_a")) & (F.col(predicted) == F.col("_p")), "left")
    return t.agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.avg(F.coalesce("cost", F.lit(0.0))).alias("mean_cost"))


def confusion_chi_square(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """chi2 and df of the independence of actual and predicted classes."""
    from ..functions.stats import chi_square

    return chi_square(confusion(df, actual, predicted).select(F.col("actual").alias("outer"), F.col("predicted").alias("inner"), F.col("n").cast("double").alias("w")))


def cumulative_counts(df: DataFrame, p: str, positive: Column) -> DataFrame:
    """p, neg, pos: how many negatives and positives have this probability or more."""
    c = df.groupBy(F.col(p).alias("p")).agg(F.sum((~positive).cast("double")).alias("_neg"), F.sum(positive.cast("double")).alias("_pos"))
    return running(c, "p", {"neg": F.col("_neg"), "pos": F.col("_pos")}, descending=True).select("p", "neg", "pos")


def calibration(df: DataFrame, p: str, positive: Column, points: int = 21, share: float = 0.5) -> DataFrame:
    """point, y: the share of positives by predicted probability, as a local regression."""
    from ..functions.comparisons import loess

    at = df.sparkSession.createDataFrame([(i / (points - 1),) for i in range(points)], "point double")
    return loess(df.withColumn("_y", positive.cast("double")), p, "_y", at, share)


def multiclass_auc(probabilities: DataFrame, key: str, actual: str, classes: list, how: str = "one_against_all", weighted: bool = True) -> DataFrame:
    """auc from (key, class, probability, actual): the mean over classes, or over pairs of classes, weighted by their rows.

    All classes (or pairs) are counted at once, each a group of the running sum.
    """
    rows = probabilities.select(F.col("class").alias("c"), F.col("probability").alias("p"), F.col(actual).alias("y"))
    if how == "one_against_all":
        cells = rows.groupBy("c", "p").agg(F.sum((F.col("y") == F.col("c")).cast("double")).alias("pos"), F.sum((F.col("y") != F.col("c")).cast("double")).alias("neg"))
        keys = ["c"]
    else:  # pairs: rows of two classes by the probability of the one, each way
        other = F.explode(F.array(*[F.lit(c) for c in classes])).alias("o")
        two = rows.select("c", "p", "y", other).where("o <> c AND (y = c OR y = o)")
        cells = two.groupBy("c", "o", "p").agg(F.sum((F.col("y") == F.col("c")).cast("double")).alias("pos"), F.sum((F.col("y") == F.col("o")).cast("double")).alias("neg"))
        keys = ["c", "o"]
    upto = running(cells, "p", {"below": F.col("neg")}, keys)
    each = upto.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)).alias("s"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 0 AND neg > 0")
    one = F.col("s") / (F.col("pos") * F.col("neg"))
    # a class weighs as its rows, a pair as the product of its classes
    weight = (F.col("pos") if how == "one_against_all" else F.col("pos") * F.col("neg")) if weighted else F.lit(1.0)
    return each.agg((F.sum(one * weight) / F.sum(weight)).alias("auc"))


def compare_aucs(df: DataFrame, a: str, b: str, positive: Column) -> DataFrame:
    """auc_a, auc_b and z of their difference (DeLong, 1988), two classifiers over the same rows."""
    rows = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"), positive.cast("int").alias("_y"))

    def placed(d: DataFrame, p: str, out: str) -> DataFrame:
        # of a positive, the share of negatives below it; of a negative, the share of positives above it
        c = d.groupBy(p).agg(F.sum(F.col("_y").cast("double")).alias("pos"), F.sum(1.0 - F.col("_y")).alias("neg"))
        up = running(c, p, {"cpos": F.col("pos"), "cneg": F.col("neg")})
        total = c.agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
        table = up.crossJoin(F.broadcast(total)).select(F.col(p).alias("_k"), ((F.col("cneg") - F.col("neg") / 2) / F.col("tn")).alias("_v1"), ((F.col("tp") - F.col("cpos") + F.col("pos") / 2) / F.col("tp")).alias("_v0"))
        return d.join(table, F.col(p) == F.col("_k")).withColumn(out, F.when(F.col("_y") == 1, F.col("_v1")).otherwise(F.col("_v0"))).drop("_k", "_v1", "_v0")

    v = placed(placed(rows, "_a", "_va"), "_b", "_vb")
    at = lambda y, c: F.when(F.col("_y") == y, F.col(c))
    s = v.agg(F.avg(at(1, "_va")).alias("auc_a"), F.avg(at(1, "_vb")).alias("auc_b"), F.var_samp(at(1, "_va") - at(1, "_vb")).alias("d1"), F.var_samp(at(0, "_va") - at(0, "_vb")).alias("d0"), F.sum("_y").alias("n1"), F.sum(1 - F.col("_y")).alias("n0"))
    return s.select("auc_a", "auc_b", ((F.col("auc_a") - F.col("auc_b")) / F.sqrt(F.col("d1") / F.col("n1") + F.col("d0") / F.col("n0"))).alias("z"))


def average_ranks(scores: DataFrame, key: str, name: str, score: str) -> DataFrame:
    """name, rank: the mean rank of each learner over data sets (key), best score first, ties share the mean."""
    from ..functions.stats import ranks

    return ranks(scores.withColumn("_s", -F.col(score)), "_s", [key], "_r").groupBy(name).agg(F.avg("_r").alias("rank"))


#: Studentised ranges over root 2 of Nemenyi's test, for 2 to 10 learners.  Fixed values (Demsar, 2006).
NEMENYI = {0.05: (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164), 0.1: (1.645, 2.052, 2.291, 2.459, 2.589, 2.693, 2.780, 2.855, 2.920)}


def critical_difference(learners: int, data_sets: int, alpha: float = 0.05) -> float:
    """By how much mean ranks must differ."""
    return NEMENYI[alpha][learners - 2] * (learners * (learners + 1) / (6 * data_sets)) ** 0.5
