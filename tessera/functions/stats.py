"""Weighted statistics, distributions, contingencies and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.ordered import numbered, running

ONE = F.lit


def _w(weight: Column | None) -> Column:
    return F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))


def basic(x: Column, weight: Column | None = None) -> dict[str, Column]:
    """n, sum, sum2, min, max, avg, dev (population) of known values; all null-safe aggregates."""
    known = F.when(x.isNotNull(), _w(weight))
    n, s, s2 = F.sum(known), F.sum(known * x), F.sum(known * x * x)
    avg = s / F.nullif(n, F.lit(0.0))
    return {"n": F.coalesce(n, F.lit(0.0)), "sum": s, "sum2": s2, "min": F.min(x), "max": F.max(x), "avg": avg, "dev": F.sqrt(F.greatest(s2 / F.nullif(n, F.lit(0.0)) - avg * avg, F.lit(0.0)))}


def domain_stats(df: DataFrame, columns: list[str], by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """A row of basic statistics for each column, in one pass: the columns are unpivoted."""
    long = unpivot(df, columns, list(by), weight)
    return long.groupBy(*by, "variable").agg(*[c.alias(k) for k, c in basic(F.col("value"), F.col("_w")).items()])


def unpivot(df: DataFrame, columns: list[str], keep: list[str] = (), weight: Column | None = None, as_text: bool = False) -> DataFrame:
    kind = "string" if as_text else "double"
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(kind).alias("value")) for c in columns])).alias("_x")
    return df.select(*keep, _w(weight).alias("_w"), pairs).select(*keep, "_w", "_x.variable", "_x.value")


def distribution(df: DataFrame, column: str, weight: Column | None = None, normalize: bool = False) -> DataFrame:
    """value, w of the known values; normalised, w is a share."""
    d = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.sum(_w(weight)).alias("w"))
    return d.join(F.broadcast(d.agg(F.sum("w").alias("_t")))).select("value", (F.col("w") / F.col("_t")).alias("w")) if normalize else d


def distribution_summary(df: DataFrame, column: str, weight: Column | None = None) -> DataFrame:
    """abs (weight of known values), unknowns, cases."""
    missing = F.col(column).isNull()
    w = _w(weight)
    return df.agg(F.coalesce(F.sum(F.when(~missing, w)), F.lit(0.0)).alias("abs"), F.coalesce(F.sum(F.when(missing, w)), F.lit(0.0)).alias("unknowns"), F.coalesce(F.sum(w), F.lit(0.0)).alias("cases"))


def combine(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """Distribution a + factor * b."""
    return a.unionByName(b.withColumn("w", F.col("w") * factor)).groupBy("value").agg(F.sum("w").alias("w"))


def modus(dist: DataFrame) -> DataFrame:
    """The value of most weight, the least of several."""
    return dist.agg(F.max_by(F.col("value"), F.col("w")).alias("_any"), F.max("w").alias("w")).join(dist.withColumnRenamed("w", "_w"), F.col("w") == F.col("_w")).groupBy("w").agg(F.min("value").alias("value")).select("value", "w")


def spread(x: Column, weight: Column | None = None) -> dict[str, Column]:
    """Average, variance and deviation (population), and standard error of the average."""
    w = F.when(x.isNotNull(), _w(weight))
    n, s, s2 = F.sum(w), F.sum(w * x), F.sum(w * x * x)
    ss = F.greatest(s2 - s * s / n, F.lit(0.0))
    return {"average": s / n, "var": ss / n, "dev": F.sqrt(ss / n), "error": F.when(n > 1, F.sqrt(ss / (n - 1) / n))}


def percentiles(dist: DataFrame, wanted: list[float]) -> DataFrame:
    """percentile, value: the weight is walked in ascending order; an exact hit gives the mean of two neighbours."""
    walked = running(dist, "value", {"cum": F.col("w")}, following="next")
    rows = []
    for p in wanted:
        togo = F.lit(float(p)) / 100 * F.col("total")
        after = F.col("cum") - togo
        got = F.when(F.lit(p == 0), F.min("value")).when(F.lit(p == 100), F.max("value"))
        hit = F.min(F.struct("value", F.when((F.abs(after) <= 1e-9) & F.col("next").isNotNull(), (F.col("value") + F.col("next")) / 2).otherwise(F.col("value")).alias("v")))
        total = dist.agg(F.sum("w").alias("total"))
        base = walked.join(F.broadcast(total))
        first = base.where(after >= -1e-9) if 0 < p < 100 else base
        rows.append(first.agg((hit["v"] if 0 < p < 100 else got).alias("value")).select(F.lit(float(p)).alias("percentile"), "value"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def density(dist: DataFrame, at: float) -> DataFrame:
    """Weight at a point, linear between neighbouring values, 0 outside."""
    pair = F.struct("value", "w")
    near = dist.agg(F.max(F.when(F.col("value") <= at, pair)).alias("a"), F.min(F.when(F.col("value") > at, pair)).alias("b"))
    between = F.col("a.w") + (at - F.col("a.value")) / (F.col("b.value") - F.col("a.value")) * (F.col("b.w") - F.col("a.w"))
    return near.select(F.coalesce(F.when(F.col("a.value") == at, F.col("a.w")).otherwise(between), F.lit(0.0)).alias("density"))


def contingency(df: DataFrame, outer: str, inner: str, weight: Column | None = None, normalize: bool = False) -> DataFrame:
    """outer, inner, w; a missing outer value is a group of its own, a missing inner value is left out."""
    t = df.where(F.col(inner).isNotNull()).groupBy(F.col(outer).alias("outer"), F.col(inner).alias("inner")).agg(F.sum(_w(weight)).alias("w"))
    return t.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("outer"))) if normalize else t


def domain_contingency(df: DataFrame, columns: list[str], cls: str, weight: Column | None = None) -> DataFrame:
    """variable, value, class, w for all columns at once."""
    long = unpivot(df.where(F.col(cls).isNotNull()), columns, [cls], weight, as_text=True).where(F.col("value").isNotNull())
    return long.groupBy("variable", "value", F.col(cls).alias("class")).agg(F.sum("_w").alias("w"))


def probabilities(dist: DataFrame, how: str = "relative", k: int | None = None, m: float = 2.0, prior: DataFrame | None = None) -> DataFrame:
    """value, p by relative frequencies, Laplace's rule (k values), or the m-estimate with a prior distribution."""
    total = dist.agg(F.sum("w").alias("_n"), F.count(F.lit(1)).alias("_k"))
    d = dist.join(F.broadcast(total))
    if how == "relative":
        return d.select("value", (F.col("w") / F.col("_n")).alias("p"))
    if how == "laplace":
        return d.select("value", ((F.col("w") + 1) / (F.col("_n") + (F.col("_k") if k is None else F.lit(k)))).alias("p"))
    prior = dist if prior is None else prior
    share = prior.join(F.broadcast(prior.agg(F.sum("w").alias("_t")))).select(F.col("value").alias("_v"), (F.col("w") / F.col("_t")).alias("_p"))
    return d.join(F.broadcast(share), F.col("value").eqNullSafe(F.col("_v")), "left").select("value", ((F.col("w") + m * F.coalesce("_p", F.lit(0.0))) / (F.col("_n") + m)).alias("p"))


# --- measures of one list --------------------------------------------------------------------


def measures(x: Column) -> dict[str, Column]:
    """Means and moments of a column; moments are biased and kurtosis is not in excess."""
    return {
        "geometricmean": F.exp(F.avg(F.ln(x))), "harmonicmean": F.count(x) / F.sum(1 / x), "mean": F.avg(x), "samplevar": F.var_pop(x), "samplestd": F.stddev_pop(x),
        "var": F.var_samp(x), "std": F.stddev_samp(x), "sterr": F.stddev_samp(x) / F.sqrt(F.count(x).cast("double")), "variation": 100 * F.stddev_pop(x) / F.avg(x),
        "skewness": F.skewness(x), "kurtosis": F.kurtosis(x) + 3, "sum": F.sum(x), "ss": F.sum(x * x), "sumsquared": F.sum(x) * F.sum(x),
    }


def moment(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k-th central moment; the first is the mean."""
    if k == 1:
        return df.agg(F.avg(column).alias("moment"))
    mean = df.agg(F.avg(column).alias("_m"))
    return df.join(F.broadcast(mean)).agg(F.avg(F.pow(F.col(column) - F.col("_m"), F.lit(k))).alias("moment"))


def products(x: Column, y: Column) -> dict[str, Column]:
    return {"summult": F.sum(x * y), "sumdiffsquared": F.sum((x - y) * (x - y))}


def mode_list(df: DataFrame, column: str) -> DataFrame:
    """All values that occur most, and how often."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("_most"))), F.col("n") == F.col("_most")).drop("_most")


def z_scores(df: DataFrame, column: str, name: str = "z") -> DataFrame:
    s = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.join(F.broadcast(s)).withColumn(name, (F.col(column) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def ranks(df: DataFrame, column: str, by: list[str] = (), name: str = "rank") -> DataFrame:
    """Ranks from 1, ties share the mean; over counts of the distinct values, not over rows."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    r = running(counts, column, {"_upto": F.col("_n")}, by).withColumn(name, F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).drop("_n", "_upto")
    keys = [*by, column]
    renamed = r.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, on).drop(*[f"_k{i}" for i in range(len(keys))])


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return ranks(ranks(df, x, name="_rx"), y, name="_ry").agg(F.corr("_rx", "_ry").alias("rho"))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, r, stderr of a straight line."""
    n, sxx, syy, sxy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx).alias("stderr"))


def t_one(df: DataFrame, x: str, mean: float) -> DataFrame:
    n = F.count(x)
    return df.agg(((F.avg(x) - mean) / (F.stddev_samp(x) / F.sqrt(n.cast("double")))).alias("t"), (n - 1).alias("df"))


def t_independent(df: DataFrame, x: str, group: Column) -> DataFrame:
    """Pooled t of the rows where `group` holds against the others."""
    a, b = F.when(group, F.col(x)), F.when(~group, F.col(x))
    n1, n2 = F.count(a), F.count(b)
    pooled = ((n1 - 1) * F.var_samp(a) + (n2 - 1) * F.var_samp(b)) / (n1 + n2 - 2)
    return df.agg(((F.avg(a) - F.avg(b)) / F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t"), (n1 + n2 - 2).alias("df"))


def t_paired(df: DataFrame, x: str, y: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    n = F.count(d)
    return df.agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(n.cast("double")))).alias("t"), (n - 1).alias("df"))


def f_one_way(df: DataFrame, x: str, group: str) -> DataFrame:
    """F of a one-way analysis of variance, with both degrees of freedom."""
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    n, k, s = F.sum("n"), F.count(F.lit(1)), F.sum("s")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    within = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    return g.agg((between / (k - 1) / (within / (n - k))).alias("f"), (k - 1).alias("df1"), (n - k).alias("df2"))


def rank_sums(df: DataFrame, x: str, group: Column) -> DataFrame:
    """Wilcoxon's z of the rank sum and Mann and Whitney's smaller U, for rows where `group` holds."""
    r = ranks(df.withColumn("_g", group), x, name="_r")
    n1, n2 = F.sum(F.col("_g").cast("int")), F.sum((~F.col("_g")).cast("int"))
    s = F.sum(F.when(F.col("_g"), F.col("_r")))
    u1 = n1 * n2 + n1 * (n1 + 1) / 2 - s
    return r.agg(((s - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)).alias("z"), F.least(u1, n1 * n2 - u1).alias("u"))


def chi_square(table: DataFrame) -> DataFrame:
    """chi2 and degrees of freedom of a contingency table (outer, inner, w)."""
    rows = table.groupBy("outer").agg(F.sum("w").alias("_r"))
    cols = table.groupBy("inner").agg(F.sum("w").alias("_c"))
    n = table.agg(F.sum("w").alias("_n"), (F.count_distinct("outer") - 1).alias("_a"), (F.count_distinct("inner") - 1).alias("_b"))
    # empty cells add their expectation; sum(o^2/e) - n needs the others only
    cells = table.join(F.broadcast(rows), "outer").join(F.broadcast(cols), "inner").join(F.broadcast(n))
    return cells.groupBy("_n", "_a", "_b").agg(F.sum(F.col("w") * F.col("w") * F.col("_n") / (F.col("_r") * F.col("_c"))).alias("_s")).select((F.col("_s") - F.col("_n")).alias("chi2"), (F.col("_a") * F.col("_b")).alias("df"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, n over bins that reach half a bin beyond the range; relative and cumulative counts beside."""
    s = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    size = (F.col("_b") - F.col("_a") + (F.col("_b") - F.col("_a")) / bins + 1) / bins
    base = df.join(F.broadcast(s)).withColumn("_size", size).withColumn("bin", F.floor((F.col(column) - (F.col("_a") - F.col("_size") / 2)) / F.col("_size")).cast("int"))
    counts = base.where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("rel"), F.sum("n").over(Window.orderBy("bin")).alias("cum"))


def score_at_percentile(df: DataFrame, column: str, p: float) -> DataFrame:
    """The element of the sorted list at n * p / 100, rounded; found in the counts of values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("w"))
    cum = running(counts, "value", {"cum": F.col("w")}).join(F.broadcast(counts.agg(F.sum("w").alias("n"))))
    at = F.least(F.floor(F.col("n") * p / 100 + 0.5), F.col("n") - 1)
    return cum.where(F.col("cum") > at).agg(F.min("value").alias("value"))


def percentile_of_score(df: DataFrame, column: str, score: float) -> DataFrame:
    return df.agg((100 * F.avg((F.col(column) < score).cast("int"))).alias("percentile"))


def trim_both(df: DataFrame, column: str, share: float) -> DataFrame:
    """Without the least and greatest shares of rows."""
    n = df.count()
    cut = int(share * n)
    return numbered(df, [column], "_place").where(F.col("_place").between(cut, n - cut - 1)).drop("_place")
