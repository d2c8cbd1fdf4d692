"""Tests and associations of samples, and local regression; ranks and pairs are counted by running sums, never gathered."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import numbered, running
from .stats import correlation, ranks


def point_biserial(df: DataFrame, group: Column, y: str) -> DataFrame:
    """r of a two-valued column with a continuous one."""
    return correlation(df.withColumn("_g", group.cast("double")), "_g", y)


def chi_square_one_way(counts: DataFrame, observed: str, expected: str | None = None) -> DataFrame:
    """chi2 and df of observed counts against expected ones, or equal ones."""
    total = counts.agg(F.avg(observed).alias("_e"))
    e = F.col("_e") if expected is None else F.col(expected)
    d = F.col(observed) - e
    return counts.crossJoin(F.broadcast(total)).agg(F.sum(d * d / e).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))


def pair_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """concordant, discordant, ties_x, ties_y, ties_both, pairs: of all pairs of rows.

    Whether y rises between two rows with different x shows at the first bit in
    which the ranks of their y differ. So for every bit, rows with equal higher bits
    form a group, in which the zeros (or ones) before a row are a running sum.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w"))
    order = numbered(known.select("y").distinct(), ["y"], "r")
    most = order.agg(F.max("r").alias("m")).first().m or 0
    levels = max(int(most).bit_length(), 1)
    placed = known.join(order, "y")
    bits = placed.select("x", "w", "r", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    high, bit = F.call_function("shiftright", "r", F.col("level") + 1), F.call_function("shiftright", "r", F.col("level")).bitwiseAND(F.lit(1))
    cells = bits.groupBy("level", high.alias("g"), "x").agg(F.sum(F.when(bit == 0, F.col("w")).otherwise(0)).alias("zero"), F.sum(F.when(bit == 1, F.col("w")).otherwise(0)).alias("one"))
    upto = running(cells, "x", {"_z": F.col("zero"), "_o": F.col("one")}, ["level", "g"])
    cross = upto.agg(F.coalesce(F.sum(F.col("one") * (F.col("_z") - F.col("zero"))), F.lit(0)).alias("concordant"), F.coalesce(F.sum(F.col("zero") * (F.col("_o") - F.col("one"))), F.lit(0)).alias("discordant"))
    pairs = lambda w: F.coalesce(F.expr(f"sum({w} * ({w} - 1) div 2)"), F.lit(0))
    tie = lambda keys, name: known.groupBy(*keys).agg(F.sum("w").alias("v")).agg(pairs("v").alias(name))
    parts = [cross, tie(["x"], "ties_x"), tie(["y"], "ties_y"), tie(["x", "y"], "ties_both"), known.agg(F.sum("w").alias("v")).select(F.expr("coalesce(v * (v - 1) div 2, 0)").alias("pairs"))]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau (with ties in either column) and z of a large sample."""
    p = pair_counts(df, x, y)
    free = lambda c: (F.col("pairs") - F.col(c)).cast("double")
    tau = (F.col("concordant") - F.col("discordant")) / F.sqrt(free("ties_x") * free("ties_y"))
    # pairs = n (n - 1) / 2
    n = (1 + F.sqrt(1 + 8.0 * F.col("pairs"))) / 2
    return p.select("concordant", "discordant", tau.alias("tau"), (tau / F.sqrt((4 * n + 10) / (9 * n * (n - 1)))).alias("z"))


def friedman(df: DataFrame, columns: list[str]) -> DataFrame:
    """chi2, df and F (Iman and Davenport) of the ranks of columns within each row; ties share the mean."""
    k = len(columns)
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rank = lambda v: F.size(F.filter(x, lambda u: u < v)) + (F.size(F.filter(x, lambda u: u == v)) + 1) / 2
    known = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))).select(F.transform(x, rank).alias("r"))
    sums = known.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("r", i)).alias(f"r{i}") for i in range(k)])
    squares = reduce(add, (F.col(f"r{i}") * F.col(f"r{i}") for i in range(k)))
    chi2 = 12 * squares / (F.col("n") * k * (k + 1)) - 3 * F.col("n") * (k + 1)
    return sums.select(chi2.alias("chi2"), F.lit(k - 1).alias("df"), ((F.col("n") - 1) * chi2 / (F.col("n") * (k - 1) - chi2)).alias("f"))


def anova_repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """F of repeated measures (columns) over subjects (rows), with both degrees of freedom."""
    k = len(columns)
    known = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))
    row = reduce(add, (F.col(c) for c in columns))
    n = F.col("n")
    s = known.agg(F.count(F.lit(1)).alias("n"), F.sum(row * row / k).alias("subjects"), F.sum(reduce(add, (F.col(c) * F.col(c) for c in columns))).alias("squares"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)])
    whole = reduce(add, (F.col(f"s{i}") for i in range(k)))
    mean = whole * whole / (n * k)
    between = reduce(add, (F.col(f"s{i}") * F.col(f"s{i}") / n for i in range(k))) - mean
    error = F.col("squares") - F.col("subjects") - between
    return s.select((between / (k - 1) / (error / ((n - 1) * (k - 1)))).alias("f"), F.lit(k - 1).alias("df1"), ((n - 1) * (k - 1)).alias("df2"))


def signed_ranks(df: DataFrame, x: str, y: str) -> DataFrame:
    """Wilcoxon's t (the smaller sum of signed ranks of differences; zeros are left out) and its z."""
    d = df.select((F.col(x) - F.col(y)).alias("_d")).where("_d <> 0").withColumn("_a", F.abs("_d"))
    r = ranks(d, "_a", name="_r")
    up, down = F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0))
    n = F.count(F.lit(1)).cast("double")
    t = F.least(up, down)
    return r.agg(t.alias("t"), ((t - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def trim_one(df: DataFrame, column: str | list[str], share: float, tail: str = "right") -> DataFrame:
    """Without the greatest (right) or least (left) share of rows, by a column or by several in turn."""
    n = df.count()
    gone = int(share * n)
    kept = F.col("_place") < n - gone if tail == "right" else F.col("_place") >= gone
    return numbered(df, [column] if isinstance(column, str) else column, "_place").where(kept).drop("_place")


def grid_points(df: DataFrame, column: str, n: int) -> DataFrame:
    """point: n places at even distances from the least to the greatest value."""
    ends = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"))
    return ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("a") + i * (F.col("b") - F.col("a")) / max(n - 1, 1))).alias("point"))


def between_points(df: DataFrame, column: str, factor: int) -> DataFrame:
    """point: every distinct value, and factor - 1 places between each two neighbours."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).distinct()
    steps = running(values, "v", {"_n": F.lit(1)}, following="next")
    between = F.transform(F.sequence(F.lit(0), F.when(F.col("next").isNull(), 0).otherwise(factor - 1)), lambda i: F.when(i == 0, F.col("v")).otherwise(F.col("v") + i * (F.col("next") - F.col("v")) / factor))
    return steps.select(F.explode(between).alias("point"))


#: Points at which a curve may be asked for at a time: they are broadcast.
MOST_POINTS = 10_000


def _lines(weighted: DataFrame) -> DataFrame:
    """point, y: the value at 0 of a line through (dx, y) with weights w."""
    w, dx, y = F.col("w"), F.col("dx"), F.col("y")
    s = weighted.groupBy("point").agg(F.sum(w).alias("s"), F.sum(w * dx).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * y).alias("sxy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    level = F.col("sy") / F.col("s")
    return s.select("point", F.when(F.abs(det) < 1e-12 * F.col("s") * F.col("sxx"), level).otherwise((F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det).alias("y"))


def _near(df: DataFrame, x: str, y: str, points: DataFrame) -> DataFrame:
    """point, dx, y, n: sums of rows by distinct x and y, against every point."""
    if points.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points: ask in parts")
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col(y).cast("double")).alias("y"))
    return known.crossJoin(F.broadcast(points.select("point"))).select("point", (F.col("x") - F.col("point")).alias("dx"), "y", "n")


def lwr(df: DataFrame, x: str, y: str, points: DataFrame, width: float) -> DataFrame:
    """point, y: locally weighted lines with bell-shaped weights of a given width."""
    near = _near(df, x, y, points)
    return _lines(near.withColumn("w", F.col("n") * F.exp(-F.col("dx") * F.col("dx") / (2 * width * width))))


def loess(df: DataFrame, x: str, y: str, points: DataFrame, share: float = 0.5) -> DataFrame:
    """point, y: lines over the nearest share of rows, with tricube weights."""
    near = _near(df, x, y, points).withColumn("d", F.abs("dx"))
    reach = running(near.groupBy("point", "d").agg(F.sum("n").alias("n")), "d", {"upto": F.col("n")}, ["point"])
    total = near.groupBy("point").agg(F.sum("n").alias("_total"))
    bound = reach.join(F.broadcast(total), "point").where(F.col("upto") >= share * F.col("_total")).groupBy("point").agg((F.min("d") * 1.0000001).alias("h"))
    t = near.join(F.broadcast(bound), "point").where((F.col("d") < F.col("h")) | (F.col("h") == 0) & (F.col("d") == 0))
    u = F.when(F.col("h") > 0, F.col("d") / F.col("h")).otherwise(0.0)
    return _lines(t.withColumn("w", F.col("n") * F.pow(1 - F.pow(u, F.lit(3)), F.lit(3))))


def gaussian_draws(df: DataFrame, mean: float, deviation: float, name: str = "draw", seed: int = 0) -> DataFrame:
    """`df` with normal draws."""
    return df.withColumn(name, mean + deviation * F.randn(seed))


def gaussian_density(x: Column, mean: float, deviation: float) -> Column:
    z = (x - mean) / deviation
    return F.exp(-z * z / 2) / (deviation * F.sqrt(2 * F.pi()))


def draws(dist: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """`value` drawn n times, by weight, from a distribution (value, w)."""
    steps = running(dist, "value", {"hi": F.col("w")})
    total = dist.agg(F.sum("w").alias("_t"))
    grid = 1 << 16
    share = lambda c: F.floor(c / F.col("_t") * grid)
    spread = steps.crossJoin(F.broadcast(total)).select("value", ((F.col("hi") - F.col("w")) / F.col("_t")).alias("_lo"), (F.col("hi") / F.col("_t")).alias("_hi"), F.explode(F.sequence(share(F.col("hi") - F.col("w")), F.least(share(F.col("hi")), F.lit(grid - 1)))).alias("_b"))
    asked = dist.sparkSession.range(n).select("id", F.rand(seed).alias("_u")).withColumn("_b", F.floor(F.col("_u") * grid))
    return asked.join(spread, "_b").where("_u >= _lo AND _u < _hi").select("id", "value")
